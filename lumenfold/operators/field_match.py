"""Form fields: what must never be filled, which dictionary entry or adapter rule a field means, what to type.

Fields: (signature, tag_name, input_type, name, id, placeholder, label_text, aria_label, nearby_text,
section_heading, class_name, autocomplete), any of them null. Dictionary entries and adapter rules are rows of
constants and become expressions: fields are neither joined with them nor shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import WS, trim
from ..functions.text import fixed3, normalize_label
from ..sources.tables import constants

# Words that mark a field as one that a person has to fill.
CAPTCHA = ("captcha", "recaptcha", "hcaptcha", "h captcha", "turnstile", "funcaptcha", "arkose", "securimage", "image code", "code shown", "code in the image", "code from image", "text shown", "verification image", "i am not a robot", "not a robot", "कैप्चा", "चित्र में दिया कोड", "सुरक्षा कोड")
ONE_TIME = ("one time password", "onetime password", "one time pin", "verification code", "verify code", "verification pin", "auth code", "authentication code", "security pin", "mpin", "sms code", "ओटीपी", "सत्यापन कोड", "एकबारगी पासवर्ड")
PAYMENT = ("card number", "cardnumber", "credit card", "debit card", "cc number", "cvv", "cvc", "csc", "card verification", "expiry", "expiration", "exp month", "exp year", "card holder", "cardholder", "name on card", "upi id", "upi pin", "vpa", "virtual payment address", "net banking password", "netbanking password", "transaction password", "atm pin", "card pin", "कार्ड नंबर", "सीवीवी", "यूपीआई")
PAYMENT_COMPLETE = ("cc-number", "cc-name", "cc-exp", "cc-exp-month", "cc-exp-year", "cc-csc", "cc-type")
SUBMIT_TYPES = ("submit", "image", "reset")
SUBMIT = ("submit", "final submit", "save and submit", "save & submit", "proceed", "proceed to pay", "confirm", "confirm and pay", "pay now", "make payment", "continue to payment", "place order", "agree and submit", "जमा करें", "सबमिट", "आगे बढ़ें", "भुगतान करें", "पुष्टि करें")
# Weights of the signals of a dictionary entry, the share kept for another input type, the score of a tie.
LABEL, ATTRIBUTE, HINT, LABEL_WORDS, ATTRIBUTE_WORDS, NEARBY, HEADING = 1.0, 0.95, 0.9, 0.8, 0.72, 0.65, 0.55
OTHER_TYPE, TIE, SAME = 0.5, 0.65, 0.001
# Scores of an adapter rule's selector, equal key and contained key.
SELECTOR, KEY, KEY_WITHIN = 1000, 900, 800

ENTRIES = "entry_no int, customer_field string, synonyms array<string>, attributes array<string>, negative array<string>, input_types array<string>, own_text_only boolean, transform string"
ADAPTER_RULES = "rule_no int, key string, customer_field string, selector string, label_patterns array<string>, negative_patterns array<string>"


def _has_any(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out |= F.contains(c, F.lit(w))
    return out


def _spaced(*names: str) -> Column:
    """The given columns, joined, in lower case, separators as single blanks."""
    joined = F.lower(F.concat_ws(" ", *[F.nullif(F.col(n), F.lit("")) for n in names]))
    return trim(F.regexp_replace(joined, rf"(?:[_.-]|{WS})+", " "))


def safety_class(fields: DataFrame) -> DataFrame:
    """fields with safety_class: payment, captcha, otp, submit (the first that holds) or normal. In doubt a field is unsafe."""
    rows = fields.withColumns({"_all": _spaced("input_type", "name", "id", "class_name", "placeholder", "label_text", "aria_label", "nearby_text", "autocomplete"), "_own": _spaced("name", "id")})
    complete = F.lower(F.coalesce("autocomplete", F.lit("")))
    kind = F.when(_has_any(complete, PAYMENT_COMPLETE) | _has_any(F.col("_all"), PAYMENT), "payment").when(_has_any(F.col("_all"), CAPTCHA), "captcha")
    kind = kind.when(F.col("_all").rlike(r"(?<![A-Za-z0-9_])otp(?![A-Za-z0-9_])") | _has_any(F.col("_all"), ONE_TIME), "otp")
    kind = kind.when(F.lower(F.coalesce("input_type", F.lit(""))).isin(*SUBMIT_TYPES) | _has_any(F.col("_own"), SUBMIT), "submit")
    return rows.withColumn("safety_class", kind.otherwise("normal")).drop("_all", "_own")


def _words(texts: list[str]) -> list[list[str]]:
    return [[w for w in t.split(" ") if len(w) > 1] for t in texts]


def _has_words(tokens: Column, texts: list[str]) -> Column:
    """Whether all words of one of the texts are among tokens."""
    out = F.lit(False)
    for words in _words(texts):
        if words:
            out |= F.size(F.array_except(F.array(*map(F.lit, words)), tokens)) == 0
    return out


def _entry_score(e) -> Column:
    """Score of one entry (its texts normalised) for a field with the columns that dictionary_match makes; null: no match."""
    synonyms, attributes = [x for x in e["synonyms"] or [] if x], [x for x in e["attributes"] or [] if x]
    wordless = [s for s, w in zip(synonyms, _words(synonyms), strict=True) if not w]
    longer = lambda n: [s for s in synonyms if len(s) > n]
    squeezed = F.replace(F.col("_attributes"), F.lit(" "))
    score = F.when(F.col("_label").isin(*synonyms), LABEL) if synonyms else F.when(F.lit(False), LABEL)
    if attributes:
        score = score.when((squeezed != "") & squeezed.isin(*[a.replace(" ", "") for a in attributes]), ATTRIBUTE).when(_has_words(F.col("_attribute_words"), attributes), ATTRIBUTE_WORDS)
    if synonyms:
        score = score.when(F.col("_aria").isin(*synonyms) | F.col("_placeholder").isin(*synonyms), HINT)
        within = _has_words(F.col("_label_words"), synonyms) | _has_any(F.col("_label"), longer(2) + wordless)
        score = score.when((F.col("_label") != "") & within, LABEL_WORDS)
        if not e["own_text_only"]:
            score = score.when(_has_any(F.col("_nearby"), longer(3)), NEARBY).when(_has_any(F.col("_heading"), longer(3)), HEADING)
    types = e["input_types"] or []
    if types:
        any_select = any(t.startswith("select") for t in types)
        fits = F.when(F.col("tag_name") == "textarea", "textarea" in types).when(F.col("tag_name") == "select", any_select).otherwise(F.lower(F.coalesce("input_type", F.lit(""))).isin(*types))
        score = score * F.when(fits, 1.0).otherwise(OTHER_TYPE)
    rejected = _has_any(F.col("_own"), e["negative"] or [])
    return F.when(~rejected, fixed3(score))


def dictionary_match(fields: DataFrame, entries: DataFrame) -> DataFrame:
    """fields with dictionary_field, dictionary_score and dictionary_transform of the best entry, the first of equals.

    An entry's first signal in this order counts: equal label, equal attributes, attribute words, equal hint, label
    words, nearby text, heading. Two best entries as good as each other score TIE at most. No match gives nulls.
    """
    texts = {"_label": normalize_label(F.col("label_text")), "_aria": normalize_label(F.col("aria_label")), "_placeholder": normalize_label(F.col("placeholder")), "_nearby": normalize_label(F.col("nearby_text")), "_heading": normalize_label(F.col("section_heading"))}
    texts["_attributes"] = normalize_label(F.concat_ws(" ", F.nullif("name", F.lit("")), F.nullif("id", F.lit(""))))
    tokens = lambda c: F.filter(F.split(c, " "), lambda w: F.length(w) > 1)
    rows = fields.withColumns(texts).withColumns({"_label_words": tokens(F.col("_label")), "_attribute_words": tokens(F.col("_attributes")), "_own": F.concat_ws(" ", "_label", "_aria", "_placeholder", "_attributes")})
    clean = lambda c: F.transform(c, normalize_label)
    found = []
    for e in sorted(constants(entries.withColumns({c: clean(F.col(c)) for c in ("synonyms", "attributes", "negative")})), key=lambda e: e["entry_no"]):
        score = _entry_score(e)
        found.append(F.when(score.isNotNull(), F.struct((-score).alias("s"), F.lit(e["entry_no"]).alias("n"), F.lit(e["customer_field"]).alias("field"), F.lit(e["transform"]).cast("string").alias("transform"))))
    if not found:
        return fields.withColumns({"dictionary_field": F.lit(None).cast("string"), "dictionary_score": F.lit(None).cast("double"), "dictionary_transform": F.lit(None).cast("string")})
    rows = rows.withColumn("_best", F.slice(F.array_sort(F.array_compact(F.array(*found))), 1, 2))
    top, other = F.get("_best", F.lit(0)), F.get("_best", F.lit(1))
    tie = F.coalesce(other["s"] - top["s"] < SAME, F.lit(False))
    score = F.when(tie, F.least(-top["s"], F.lit(TIE))).otherwise(-top["s"])
    return rows.select(*[fields[c] for c in fields.columns], top["field"].alias("dictionary_field"), score.alias("dictionary_score"), top["transform"].alias("dictionary_transform"))


def _plain(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, r"[*:?()\[\]{}.,/|—–-]+", " "), "['`‘’]", "")
    return F.lower(trim(F.regexp_replace(c, f"{WS}+", " ")))


def _split_name(c: Column) -> Column:
    c = F.regexp_replace(F.coalesce(c, F.lit("")), "([a-z0-9])([A-Z])", "$1 $2")
    return F.lower(trim(F.regexp_replace(c, rf"(?:[_.-]|{WS})+", " ")))


def adapter_match(fields: DataFrame, rules: DataFrame) -> DataFrame:
    """fields with adapter_field and adapter_score of the best rule, the first of equals; nulls where none matches.

    A negative pattern rules a rule out; else its selector within the signature, its key as name or id, its key's
    words within them, or the length of its longest label pattern count, in that order.
    """
    rows = fields.withColumns({"_hay": _plain(F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("name", "id", "label_text", "placeholder", "aria_label")])), "_name": _split_name(F.col("name")), "_id": _split_name(F.col("id"))})
    clean = lambda c: F.filter(F.transform(c, _plain), lambda x: x != "")
    ready = rules.withColumns({"label_patterns": clean(F.col("label_patterns")), "negative_patterns": clean(F.col("negative_patterns")), "key": _split_name(F.col("key"))})
    found = []
    for r in sorted(constants(ready), key=lambda r: r["rule_no"]):
        score = F.when((F.col("_hay") == "") | _has_any(F.col("_hay"), r["negative_patterns"] or []), F.lit(None).cast("int"))
        if r["selector"]:
            score = score.when(F.contains("signature", F.lit(r["selector"])), SELECTOR)
        if r["key"]:
            for own in (F.col("_name"), F.col("_id")):
                score = score.when(own == r["key"], KEY).when(F.contains(F.concat(F.lit(" "), own, F.lit(" ")), F.lit(f" {r['key']} ")), KEY_WITHIN)
        for pattern in sorted(set(r["label_patterns"] or []), key=len, reverse=True):
            score = score.when(F.contains("_hay", F.lit(pattern)), len(pattern))
        found.append(F.when(score.isNotNull(), F.struct((-score).alias("s"), F.lit(r["rule_no"]).alias("n"), F.lit(r["customer_field"]).alias("field"))))
    best = F.array_min(F.array_compact(F.array(*found))) if found else F.lit(None).cast("struct<s:int,n:int,field:string>")
    rows = rows.withColumn("_best", best)
    return rows.select(*[fields[c] for c in fields.columns], F.col("_best.field").alias("adapter_field"), (-F.col("_best.s")).alias("adapter_score"))


def fill_instructions(mappings: DataFrame, values: DataFrame, approved: DataFrame, edits: DataFrame) -> DataFrame:
    """What to type: page_id, signature, value and input_type of approved, safe fields that have a value.

    mappings: (page_id, signature, tag_name, input_type, customer_field, safety_class, skip_reason, customer_id); values:
    (customer_id, customer_field, value), transformed already, a row a key; approved: (page_id, signature); edits:
    (page_id, signature, value), a row a key, which win; an empty edit or value leaves the field out.
    """
    open_ = mappings.where("safety_class = 'normal' and customer_field is not null and coalesce(skip_reason, 'low_confidence') = 'low_confidence'")
    rows = open_.join(approved.select("page_id", "signature").distinct(), ["page_id", "signature"], "left_semi")
    rows = rows.join(edits.select("page_id", "signature", F.col("value").alias("_edit")), ["page_id", "signature"], "left")
    rows = rows.join(values.select("customer_id", "customer_field", F.col("value").alias("_value")), ["customer_id", "customer_field"], "left")
    value = F.nullif(F.coalesce("_edit", "_value"), F.lit(""))
    kind = F.when(F.col("tag_name") == "textarea", "textarea").otherwise(F.col("input_type"))
    return rows.select("page_id", "signature", value.alias("value"), kind.alias("input_type")).where("value is not null")


def edit_decisions(fields: DataFrame, form: DataFrame) -> DataFrame:
    """fields: (customer_id, key, value, encrypted); form: (customer_id, key, value). What a form changes: blanks keep, unchanged values drop out unless sealed."""
    asked = form.select("customer_id", "key", trim(F.col("value")).alias("new")).where("new <> ''")
    changed = F.col("encrypted") | (F.col("new") != F.coalesce("value", F.lit("")))
    return fields.join(asked, ["customer_id", "key"]).where(changed).select("customer_id", "key", F.lit("edit").alias("action"), F.col("new").alias("value"))
