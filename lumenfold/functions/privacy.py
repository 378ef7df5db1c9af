"""Masking, scrubbing, redaction and sealing of personal data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .json_text import let, parsed, quote
from .normalize import WS, digits, last_four, trim

BULLET = "•"
MOST_DEPTH, MOST_ITEMS, MOST_CHARS = 6, 20, 200

# Parts of key names whose values are dropped, and key names that are kept all the same.
SENSITIVE = "aadhaar aadhar pan account ifsc card cvv otp password passwd secret token apikey api_key authorization cookie session signature full_name fullname father_name mother_name spouse_name guardian_name mobile phone email address dob date_of_birth income category caste religion disability raw_text rawtext sourcetext source_text value values proposed_value voter passport licence license ration".split()
KEPT = "valueType valueCount sessionId accountStatus panelSide".split()

# ASCII word boundaries: Java's \b takes Devanagari letters for word characters.
_B = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
_SEP = rf"(?:{WS}|-)?"
#: Identifier shapes in the order in which they are replaced.
SCRUBS = (
    (rf"{_B}[0-9]{{4}}{_SEP}[0-9]{{4}}{_SEP}[0-9]{{4}}{_B}", "[redacted:id12]"),
    (rf"{_B}[A-Z]{{5}}[0-9]{{4}}[A-Z]{_B}", "[redacted:pan]"),
    (rf"{_B}(?:\+?91{_SEP})?[6-9][0-9]{{9}}{_B}", "[redacted:mobile]"),
    (rf"{_B}[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+{_B}", "[redacted:email]"),
    (rf"{_B}[0-9]{{9,18}}{_B}", "[redacted:digits]"),
)


def _dots(n: Column) -> Column:
    return F.repeat(F.lit(BULLET), n.cast("int"))


def _given(c: Column, out: Column) -> Column:
    """out, or null where the input is null or empty."""
    return F.when(F.length(c) > 0, out)


def mask_aadhaar(c: Column) -> Column:
    return F.concat(F.lit("XXXX XXXX "), last_four(c))


def mask_pan(c: Column) -> Column:
    v = F.upper(trim(c))
    return _given(c, F.when(F.length(v) == 10, F.concat(F.left(v, F.lit(3)), F.lit(BULLET * 4), F.right(v, F.lit(2)))).otherwise(F.concat(F.lit(BULLET * 6), F.right(v, F.lit(2)))))


def mask_mobile(c: Column) -> Column:
    d = digits(c)
    return F.when(F.length(d) >= 4, F.concat(_dots(F.length(d) - 4), F.right(d, F.lit(4))))


def mask_account(c: Column) -> Column:
    v = trim(c)
    return _given(c, F.when(F.length(v) <= 4, _dots(F.length(v))).otherwise(F.concat(_dots(F.length(v) - 4), F.right(v, F.lit(4)))))


def mask_email(c: Column) -> Column:
    at = F.instr(c, "@")
    return _given(c, F.when(at <= 1, _dots(F.length(c))).otherwise(F.concat(F.left(c, F.lit(1)), _dots(F.greatest(F.lit(1), at - 2)), F.substring(c, at, F.length(c)))))


def mask_name(c: Column) -> Column:
    words = F.filter(F.split(trim(c), f"{WS}+"), lambda w: w != "")
    return F.when(F.size(words) > 0, F.array_join(F.transform(words, lambda w: F.concat(F.left(w, F.lit(1)), F.lit("…"))), " "))


def preview(c: Column) -> Column:
    """A short preview of a value for logs."""
    v = trim(c)
    return F.when(v == "", "").when(v.rlike(rf"^[0-9](?:[0-9-]|{WS})*$"), F.coalesce(mask_mobile(v), F.lit(BULLET * 4))).when(F.length(v) <= 3, F.concat(F.left(v, F.lit(1)), F.lit("…"))).otherwise(F.concat(F.left(v, F.lit(2)), F.lit("…("), F.length(v), F.lit(")")))


def scrub(c: Column) -> Column:
    """Free text without identifiers, cut off after MOST_CHARS characters."""
    for pattern, label in SCRUBS:
        c = F.regexp_replace(c, pattern, label)
    return F.when(F.length(c) > MOST_CHARS, F.concat(F.left(c, F.lit(MOST_CHARS)), F.lit("…[+"), F.length(c) - MOST_CHARS, F.lit("]"))).otherwise(c)


def mask_identifiers(c: Column) -> Column:
    """Twelve-digit runs keep their last four digits."""
    return F.regexp_replace(c, rf"(?<![0-9])[0-9]{{4}}{_SEP}[0-9]{{4}}{_SEP}([0-9]{{4}})(?![0-9])", "XXXX XXXX $1")


def has_identifier(c: Column) -> Column:
    return c.rlike(rf"(?<![0-9])[0-9]{{4}}{_SEP}[0-9]{{4}}{_SEP}[0-9]{{4}}(?![0-9])")


_SENSITIVE = "(?i)" + "|".join(SENSITIVE)


def _kind(value: Column) -> Column:
    """What a variant is: OBJECT, ARRAY, STRING, BOOLEAN, VOID, else a number."""
    return F.regexp_extract(F.coalesce(F.schema_of_variant(value), F.lit("VOID")), "^[A-Z]+", 0)


def _described(kind: Column, raw: Column) -> Column:
    words = {"VOID": F.lit("null"), "BOOLEAN": F.lit("boolean"), "STRING": F.concat(F.lit("string:"), F.length(raw)), "ARRAY": F.concat(F.lit("array:"), F.json_array_length(raw)), "OBJECT": F.lit("object")}
    found = F.coalesce(*[F.when(kind == k, v) for k, v in words.items()], F.lit("number"))
    return F.concat(F.lit('"[redacted:'), found, F.lit(']"'))


def _redacted(value: Column, raw: Column, depth: int) -> Column:
    """JSON text of a variant without secrets; raw: a string itself, of all else the JSON text."""

    def whole(s: Column) -> Column:
        kind, raw, value = s["kind"], s["raw"], s["value"]
        leaf = F.when(kind == "STRING", quote(scrub(raw))).when(kind == "VOID", "null").otherwise(F.to_json(value))
        nested = kind.isin("OBJECT", "ARRAY")
        if depth == MOST_DEPTH:
            return F.when(nested, '"[redacted:depth]"').otherwise(leaf)
        pair = lambda name, text, item: F.struct(name.alias("name"), text.alias("raw"), item.alias("value"))
        named = F.zip_with(F.map_entries(F.from_json(raw, "map<string,string>")), F.map_values(F.from_json(raw, "map<string,variant>")), lambda e, v: pair(e["key"], e["value"], v))
        items = F.zip_with(F.slice(F.from_json(raw, "array<string>"), 1, MOST_ITEMS), F.slice(F.from_json(raw, "array<variant>"), 1, MOST_ITEMS), lambda t, v: pair(F.lit(None).cast("string"), t, v))
        more = F.json_array_length(raw) - MOST_ITEMS

        def one(x: Column) -> Column:
            hidden = x["name"].rlike(_SENSITIVE) & ~x["name"].isin(*KEPT)
            text = F.when(hidden, let(_kind(x["value"]), lambda k: _described(k, x["raw"]))).otherwise(_redacted(x["value"], x["raw"], depth + 1))
            return F.concat(F.when(x["name"].isNull(), "").otherwise(F.concat(quote(x["name"]), F.lit(":"))), text)

        def joined(texts: Column) -> Column:
            list_ = F.concat(texts, F.when(more > 0, F.array(F.concat(F.lit('"[+'), more, F.lit(' more]"')))).otherwise(F.array().cast("array<string>")))
            return F.when(kind == "OBJECT", F.concat(F.lit("{"), F.array_join(texts, ","), F.lit("}"))).otherwise(F.concat(F.lit("["), F.array_join(list_, ","), F.lit("]")))

        return F.when(nested, let(F.transform(F.when(kind == "OBJECT", named).otherwise(items), one), joined)).otherwise(leaf)

    return let(F.struct(_kind(value).alias("kind"), raw.alias("raw"), value.alias("value")), whole)


def redact_json(c: Column) -> Column:
    """JSON text with sensitive members described and strings scrubbed, below MOST_DEPTH levels cut off; null where it is no JSON.

    Members keep their order. Nothing recurses with the text: what nests deeper than Spark reads JSON, or names a member
    twice, or has more after it, is no JSON. Numbers are written as Spark writes them; a lone surrogate becomes a question mark.
    """

    def whole(text: Column) -> Column:
        own = lambda v: F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(text)
        return let(parsed(text), lambda v: F.when(v.isNotNull(), _redacted(v, own(v), 0)))

    # the text is made once and parsed once as a whole, however often the expression names them
    return let(c, whole)


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def seal(c: Column, key: Column, aad: Column) -> Column:
    """AES-256-GCM as v1.iv.tag.ciphertext (base64 parts)."""
    raw = F.aes_encrypt(c, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), aad)
    n = F.octet_length(raw)
    part = lambda at, size: F.base64(F.substring(raw, at, size))
    return F.concat(F.lit("v1."), part(F.lit(1), F.lit(12)), F.lit("."), part(n - 15, F.lit(16)), F.lit("."), part(F.lit(13), n - 28))


def unseal(c: Column, key: Column, aad: Column) -> Column:
    """The text sealed by seal(); null where key, context or form do not fit."""
    p = F.split(c, r"\.")
    raw = F.concat(F.unbase64(F.get(p, F.lit(1))), F.unbase64(F.get(p, F.lit(3))), F.unbase64(F.get(p, F.lit(2))))
    return F.when((F.size(p) == 4) & (F.get(p, F.lit(0)) == "v1"), F.try_aes_decrypt(raw, key, F.lit("GCM"), F.lit("DEFAULT"), aad).cast("string"))
