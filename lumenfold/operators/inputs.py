"""Checks of what users send, as columns: no row raises an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import privacy as P
from ..functions.normalize import trim
from .quality import violations

# The longest query and place, the pages' least, most and usual rows.
MOST_QUERY, MOST_PLACE, LEAST_ROWS, MOST_ROWS, USUAL_ROWS = 120, 120, 1, 100, 25
UUID = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
DAY = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def checked(rows: DataFrame, checks: list[tuple[str, Column, str]]) -> DataFrame:
    """checks: (field, condition, message). Adds errors (field to the message of its first broken check) and ok; a null condition is broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.struct(F.lit(f).alias("f"), F.lit(m).alias("m"))) for f, c, m in checks]))
    first = F.aggregate("_broken", F.create_map().cast("map<string,string>"), lambda s, b: F.when(F.map_contains_key(s, b["f"]), s).otherwise(F.map_concat(s, F.map_from_arrays(F.array(b["f"]), F.array(b["m"])))))
    return rows.withColumn("_broken", broken).withColumn("errors", first).withColumn("ok", F.size("_broken") == 0).drop("_broken")


def list_query(requests: DataFrame) -> DataFrame:
    """requests: params, a map of texts. Adds the typed members of a customer list query, errors and ok; what was not sent is null, the page size 25."""
    of = lambda name: F.try_element_at("params", F.lit(name))
    size = F.when(of("limit").isNull(), USUAL_ROWS).otherwise(F.try_to_number(trim(of("limit")), F.lit("S999999999")).cast("int"))
    whole = of("limit").isNull() | trim(of("limit")).rlike("^[+-]?[0-9]{1,9}$")
    day = lambda name: of(name).isNull() | (of(name).rlike(DAY) & F.try_to_date(of(name)).isNotNull())
    rows = requests.withColumns({"q": trim(of("q")), "district": F.nullif(trim(of("district")), F.lit("")), "state": F.nullif(trim(of("state")), F.lit("")), "assigned_to": of("assignedTo"), "missing_documents": of("missingDocuments") != "", "created_from": F.try_to_date(of("createdFrom")), "created_to": F.try_to_date(of("createdTo")), "page_size": size, "cursor": of("cursor")})
    short = lambda c, most: F.coalesce(F.length(c) <= most, F.lit(True))
    return checked(rows, [("q", short(F.col("q"), MOST_QUERY), "too_long"), ("district", short(F.col("district"), MOST_PLACE), "too_long"), ("state", short(F.col("state"), MOST_PLACE), "too_long"), ("assignedTo", of("assignedTo").isNull() | of("assignedTo").rlike(UUID), "not_a_uuid"), ("createdFrom", day("createdFrom"), "not_a_day"), ("createdTo", day("createdTo"), "not_a_day"), ("limit", whole, "not_a_number"), ("limit", F.col("page_size").between(LEAST_ROWS, MOST_ROWS), "out_of_range")])


def identity_violations(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, violation): rows whose JSON text holds a whole twelve-digit identifier, or last digits that are not four."""
    text = F.coalesce(F.col(column), F.lit(""))
    four = F.get_json_object(column, "$.aadhaar_last4")
    return violations(rows, key, full_identifier=~text.rlike(r'"aadhaar"\s*:\s*"[0-9]{12}"|"aadhaar_number"|"aadhaar_full"'), last_four=four.rlike("^[0-9]{4}$"))


# How a sensitive field is shown; any other sensitive field is four dots.
MASKS = {"customer.mobile": P.mask_mobile, "customer.mobile_alt": P.mask_mobile, "customer.email": P.mask_email, "customer.aadhaar_last4": P.mask_aadhaar, "customer.pan": P.mask_pan, "customer.bank.account_number": P.mask_account}


def masked_values(values: Column, sensitive: list[str]) -> Column:
    """A map of field values with those of the sensitive keys masked; a mask that gives nothing shows an empty text."""

    def shown(key: Column, value: Column) -> Column:
        out = F.when(~key.isin(sensitive), value)
        for name, mask in MASKS.items():
            if name in sensitive:
                out = out.when(key == name, F.coalesce(mask(value), F.lit("")))
        return out.otherwise(F.lit(P.BULLET * 4))

    return F.transform_values(values, shown)
