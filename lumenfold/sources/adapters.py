"""Packages of form adapters: JSON texts that are checked when they are loaded, layered by slug and laid out as rows.

A package with a violation is reported, by path and kind, and not loaded.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json_text import let, parsed
from ..operators.snapshots import overlay


@dataclass(frozen=True)
class Member:
    """What a member of a package has to be: string, boolean or array; least and most: characters or items; of: what an array's items are."""

    name: str
    kind: str = "string"
    required: bool = True
    least: int = 0
    most: int = 1 << 30
    one_of: tuple[str, ...] = ()
    like: str = ""
    of: tuple[Member, ...] | str = ()


# Statuses, and the bounds of every member.
STATUSES = ("draft", "testing", "active", "deprecated")
FIELD = (
    Member("key", least=1, most=80), Member("customerField", like=r"^customer\."), Member("selector", required=False, most=300), Member("labelPatterns", "array", False, most=20, of="200"),
    Member("negativePatterns", "array", False, most=30, of="200"), Member("inputType", most=40), Member("transform", required=False, most=60), Member("required", "boolean", False), Member("reviewRequired", "boolean", False), Member("dependsOn", required=False, most=80),
)
DOCUMENT = (Member("key", least=1, most=80), Member("label", most=200), Member("presetCode", required=False, most=80), Member("required", "boolean", False), Member("notes", required=False, most=300))
PACKAGE = (
    Member("id"), Member("slug", least=1, most=80), Member("portalName", least=1, most=160), Member("formName", least=1, most=160), Member("region", required=False, most=120), Member("urlPatterns", "array", least=1, most=20, of="400"), Member("version", most=20),
    Member("status", one_of=STATUSES), Member("lastVerifiedAt", required=False), Member("fields", "array", most=300, of=FIELD), Member("documentRequirements", "array", False, most=50, of=DOCUMENT), Member("notes", required=False, most=1000), Member("knownIssues", required=False, most=1000),
)

_KINDS = {"string": "^STRING", "boolean": "^BOOLEAN", "array": "^ARRAY"}
_FOUND = "array<struct<path:string,violation:string>>"
ADAPTER = "id string, slug string, portalName string, formName string, region string, urlPatterns array<string>, version string, status string, fields array<struct<key:string,customerField:string,selector:string,labelPatterns:array<string>,negativePatterns:array<string>,inputType:string,transform:string,required:boolean,reviewRequired:boolean,dependsOn:string>>, documentRequirements array<struct<key:string,label:string,presetCode:string,required:boolean,notes:string>>, notes string, knownIssues string"


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """(package, text): the files at path, each a package."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("package"), F.col("value").alias("text"))


def _wrong(value: Column, m: Member, path: Column) -> Column:
    """What is wrong with a member: array of (path, violation)."""
    one = lambda why: F.array(F.struct(path.alias("path"), F.lit(why).alias("violation")))
    none, kind = F.array().cast(_FOUND), F.schema_of_variant(value)
    text, items = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "array<variant>")
    size = F.size(items) if m.kind == "array" else F.length(text)
    found = F.when(value.isNull(), one("required") if m.required else none).when(~kind.rlike(_KINDS[m.kind]), one("type"))
    if m.kind != "boolean":
        found = found.when(size < m.least, one("too_short")).when(size > m.most, one("too_long"))
    if m.one_of:
        found = found.when(~text.isin(*m.one_of), one("enum"))
    if m.like:
        found = found.when(~text.rlike(m.like), one("pattern"))
    if m.kind != "array":
        return found.otherwise(none)
    at = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
    if isinstance(m.of, str):
        each = lambda x, i: _wrong(x, Member("", most=int(m.of)), at(i))
    else:
        each = lambda x, i: F.when(F.schema_of_variant(x).rlike("^OBJECT"), _members(x, m.of, F.concat(at(i), F.lit(".")))).otherwise(F.array(F.struct(at(i).alias("path"), F.lit("type").alias("violation"))))
    return found.otherwise(F.flatten(F.transform(items, each)))


def _members(value: Column, members: tuple[Member, ...], above: Column) -> Column:
    def one(m: Member) -> Column:
        return let(F.try_variant_get(value, f"$.{m.name}", "variant"), lambda v: _wrong(v, m, F.concat(above, F.lit(m.name))))

    return F.concat(*map(one, members))


def _checked(packages: DataFrame) -> DataFrame:
    whole = lambda v: F.when(F.coalesce(F.schema_of_variant(v).rlike("^OBJECT"), F.lit(False)), _members(v, PACKAGE, F.lit(""))).otherwise(F.array(F.struct(F.lit("").alias("path"), F.lit("no_object").alias("violation"))))
    return packages.withColumn("_found", let(parsed(F.col("text")), whole))


def violations(packages: DataFrame) -> DataFrame:
    """packages: (package, text). (package, path, violation) of all that keeps a package from being loaded."""
    return _checked(packages).select("package", F.inline("_found"))


def loaded(packages: DataFrame) -> DataFrame:
    """packages: (package, text). (package and the columns of ADAPTER) of those without violations."""
    return _checked(packages).where(F.size("_found") == 0).select("package", F.from_json("text", ADAPTER).alias("a")).select("package", "a.*")


def merged(layers: list[DataFrame]) -> DataFrame:
    """Loaded layers by slug: a later one's adapter replaces those of earlier ones."""
    return overlay(layers, ["slug"])


def url_patterns(adapters: DataFrame) -> DataFrame:
    """(slug, status, pattern), as forms.select_adapters takes them."""
    return adapters.select("slug", "status", F.explode("urlPatterns").alias("pattern"))


def field_rules(adapters: DataFrame) -> DataFrame:
    """(slug, rule_no and what field_match.ADAPTER_RULES names) of each adapter's fields, in their order; depends_on, as forms.dependency_depths takes it."""
    rows = adapters.select("slug", F.posexplode("fields").alias("rule_no", "f"))
    return rows.select("slug", "rule_no", F.col("f.key").alias("key"), F.col("f.customerField").alias("customer_field"), F.col("f.selector").alias("selector"), F.col("f.labelPatterns").alias("label_patterns"), F.col("f.negativePatterns").alias("negative_patterns"), F.col("f.transform").alias("transform"), F.coalesce("f.reviewRequired", F.lit(False)).alias("review_required"), F.col("f.dependsOn").alias("depends_on"))
