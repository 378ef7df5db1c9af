"""Form fields of HTML pages with their labels, nearby texts, headings and options.

Python parses a page into its elements; all that is decided about them are expressions over the page's own array
of elements, so pages are not shuffled. Fields of open shadow roots follow those of the document. Visibility follows
attributes, inline styles and the page's own style elements (functions/style_rules.py), no linked sheets or media rules.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markup import elements
from ..functions.text import form_signature

# The most fields and options, the longest texts, what is no field, roles that stand for controls.
MOST_FIELDS, MOST_OPTIONS, MOST_NEAR_LABEL, MOST_HEADING, MOST_OPTION = 500, 500, 120, 200, 300
STRUCTURAL = ("hidden", "submit", "reset", "button", "image")
ROLE_TYPES = {"checkbox": "checkbox", "radio": "radio", "combobox": "combobox", "listbox": "select-one", "select": "select-one", "textbox": "text", "switch": "checkbox", "slider": "range", "spinbutton": "number"}
CHOICES = ("combobox", "listbox", "select")
HEADINGS = ("h1", "h2", "h3", "h4", "legend")

_ELEMENT = [("node", pa.int32()), ("parent", pa.int32()), ("last", pa.int32()), ("prev", pa.int32()), ("ancestors", pa.list_(pa.int32())), ("label", pa.int32()), ("cell", pa.int32()), ("form", pa.int32()), ("scope", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("shown", pa.bool_()), ("text", pa.string()), ("near", pa.string())]
_SCHEMA = "array<struct<node:int,parent:int,last:int,prev:int,ancestors:array<int>,label:int,cell:int,form:int,scope:int,tag:string,attrs:map<string,string>,shown:boolean,text:string,near:string>>"
_PAGES_AT_ONCE = 64


def _parsed(batches):
    kind = pa.list_(pa.struct(_ELEMENT))
    for batch in batches:
        for at in range(0, batch.num_rows, _PAGES_AT_ONCE):
            part = batch.slice(at, _PAGES_AT_ONCE)
            found = [[{k: e[k] for k, _ in _ELEMENT} for e in elements(h)] for h in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, kind)], names=["page_id", "frame", "elements"])


def _attr(e: Column, name: str) -> Column:
    return F.try_element_at(e["attrs"], F.lit(name))


def _filled(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def _input_type(e: Column) -> Column:
    role, editable = F.lower(_attr(e, "role")), _attr(e, "contenteditable")
    own = F.when(e["tag"] == "textarea", "textarea").when(e["tag"] == "select", F.when(_attr(e, "multiple").isNotNull(), "select-multiple").otherwise("select-one"))
    of_role = F.try_element_at(F.create_map(*[F.lit(x) for kv in ROLE_TYPES.items() for x in kv]), role)
    return F.when(editable != "false", "contenteditable").otherwise(F.coalesce(of_role, own, F.lower(F.coalesce(_attr(e, "type"), F.lit("text")))))


def _is_field(e: Column) -> Column:
    return e["tag"].isin("input", "select", "textarea") | F.coalesce(_attr(e, "contenteditable").isin("true", ""), F.lit(False)) | F.coalesce(_attr(e, "role").isin(*ROLE_TYPES), F.lit(False))


def _at(node: Column) -> Column:
    return F.get("_elements", node)


def _by_id(name: Column) -> Column:
    return F.get(F.filter("_named", lambda x: _attr(x, "id") == name), F.lit(0))


def _within(column: str, e: Column, also=lambda x: F.lit(True)) -> Column:
    return F.filter(column, lambda x: (x["node"] > e["node"]) & (x["node"] <= e["last"]) & also(x))


def _label(e: Column) -> Column:
    """The text of the label for the field's id, the label around it, what labels it by id, the cell before its own, one of three elements before it."""
    explicit = F.get(F.filter("_labels", lambda x: _attr(x, "for") == F.nullif(_attr(e, "id"), F.lit(""))), F.lit(0))["text"]
    refs = F.array_compact(F.transform(F.split(F.trim(_attr(e, "aria-labelledby")), r"\s+"), lambda r: _by_id(r)["text"]))
    near = lambda x: F.when(F.length(x["text"]) <= MOST_NEAR_LABEL, x["text"])
    one, two = _at(e["prev"]), _at(_at(e["prev"])["prev"])
    return F.coalesce(explicit, _at(e["label"])["text"], F.when(F.size(refs) > 0, F.array_join(refs, " ")), near(_at(_at(e["cell"])["prev"])), near(one), near(two), near(_at(two["prev"])))


def _heading(e: Column) -> Column:
    """The first heading within the nearest of eight ancestors that has one with text."""
    texts = F.transform(e["ancestors"], lambda a: F.left(F.get(_within("_headings", _at(a)), F.lit(0))["text"], F.lit(MOST_HEADING)))
    return F.get(F.array_compact(texts), F.lit(0))


def _options(e: Column) -> Column:
    def shown(options: Column, *names: str) -> Column:
        value = lambda o: F.coalesce(*[_attr(o, n) for n in names], o["text"], F.lit(""))
        return F.transform(F.slice(options, 1, MOST_OPTIONS), lambda o: F.struct(value(o).alias("value"), F.left(F.coalesce(o["text"], F.lit("")), F.lit(MOST_OPTION)).alias("label")))

    plain = lambda x: x["tag"] == "option"
    listed = _within("_choices", _by_id(_attr(e, "list")), plain)
    popup = _within("_choices", _by_id(F.coalesce(_attr(e, "aria-controls"), _attr(e, "aria-owns"))))
    own, none = _within("_choices", e), F.array().cast("array<struct<value:string,label:string>>")
    custom = F.concat(own, F.filter(F.coalesce(popup, F.slice(own, 1, 0)), lambda x: ~((x["node"] > e["node"]) & (x["node"] <= e["last"]))))
    has_popup = F.coalesce(F.lower(_attr(e, "role")).isin(*CHOICES), F.lit(False)) | _attr(e, "aria-haspopup").isNotNull()
    found = F.when(e["tag"] == "select", shown(_within("_choices", e, plain), "value")).when(F.size(listed) > 0, shown(listed, "value")).when(has_popup & (F.size(custom) > 0), shown(custom, "data-value", "data-option", "value"))
    return F.when(e["tag"] == "select", F.coalesce(found, none)).otherwise(found)


def _has_value(e: Column) -> Column:
    kind, marked = F.lower(F.coalesce(_attr(e, "type"), F.lit("text"))), lambda x: _attr(x, "selected").isNotNull()
    options = _within("_choices", e, lambda x: x["tag"] == "option")
    chosen = F.get(F.reverse(F.filter(options, marked)), F.lit(0))
    one = chosen.isNotNull() & (chosen["node"] > F.get(options, F.lit(0))["node"]) & _filled(F.coalesce(_attr(chosen, "value"), chosen["text"]))
    several = F.exists(options, marked)
    of_input = F.when(kind.isin("checkbox", "radio"), _attr(e, "checked").isNotNull()).when(kind == "file", F.lit(False)).otherwise(_filled(_attr(e, "value")))
    of_select = F.when(_attr(e, "multiple").isNotNull(), several).otherwise(F.coalesce(one, F.lit(False)))
    slider = F.coalesce(F.lower(_attr(e, "role")) == "slider", F.lit(False))
    of_role = F.when(_attr(e, "aria-checked").isNotNull(), _attr(e, "aria-checked") == "true").when(_attr(e, "aria-valuenow").isNotNull(), ~slider & _filled(_attr(e, "aria-valuenow"))).otherwise(_filled(_attr(e, "value")))
    editable = F.coalesce(_attr(e, "contenteditable") != "false", F.lit(False))
    return F.when(e["tag"] == "input", of_input).when(e["tag"] == "textarea", _filled(e["text"])).when(e["tag"] == "select", of_select).when(editable, _filled(e["text"])).otherwise(of_role)


def detect_fields(pages: DataFrame) -> DataFrame:
    """pages: (page_id, frame, html), a row for each frame that may be read. A row for each field of a page, numbered through its frames in field_order, MOST_FIELDS at most as in each frame.

    Structural inputs, and lists that open from a combobox, are no fields. A null or empty page has none; rows that
    repeat a page's frame are further frames to it.
    """
    pages = pages.select("page_id", F.col("frame").cast("int").alias("frame"), "html")
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.mapInArrow(_parsed, f"page_id {kind}, frame int, elements {_SCHEMA}").withColumnRenamed("elements", "_elements")
    choice = lambda x: x["tag"].isin("option", "li") | F.coalesce(_attr(x, "role") == "option", F.lit(False)) | _attr(x, "data-value").isNotNull() | _attr(x, "data-option").isNotNull()
    combobox = lambda x: F.coalesce(_attr(x, "role") == "combobox", F.lit(False))
    sought = {"_fields": _is_field, "_labels": lambda x: (x["scope"] == 0) & (x["tag"] == "label") & _attr(x, "for").isNotNull(), "_named": lambda x: (x["scope"] == 0) & _attr(x, "id").isNotNull(), "_headings": lambda x: x["tag"].isin(*HEADINGS), "_choices": choice, "_combos": combobox}
    rows = rows.withColumns({c: F.filter("_elements", f) for c, f in sought.items()}).where("size(_fields) > 0")
    held = lambda e: (F.lower(_attr(e, "role")) == "listbox") & F.exists("_combos", lambda c: (e["node"] >= c["node"]) & (e["node"] <= c["last"]))

    def described(e: Column, index: Column) -> Column:
        stable = F.coalesce(F.nullif(_attr(e, "name"), F.lit("")), F.nullif(_attr(e, "id"), F.lit("")), F.concat(F.lit("idx"), index))
        parts = [F.col("frame").cast("string"), e["form"].cast("string"), F.coalesce(_attr(e, "type"), e["tag"]), stable]
        length = F.regexp_extract(_attr(e, "maxlength"), r"^\s*\+?([0-9]+)", 1).try_cast("int")
        tag = F.when(e["tag"].isin("select", "textarea"), e["tag"]).when(F.lower(_attr(e, "role")).isin(*CHOICES), "select").otherwise("input")
        own = {"_key": F.concat_ws("|", *parts), "tag_name": tag, "input_type": _input_type(e), "name": _attr(e, "name"), "id": _attr(e, "id"), "placeholder": _attr(e, "placeholder"), "label_text": _label(e), "aria_label": _attr(e, "aria-label"), "nearby_text": _at(e["parent"])["near"], "section_heading": _heading(e), "options": _options(e)}
        own |= {"required": _attr(e, "required").isNotNull() | F.coalesce(_attr(e, "aria-required") == "true", F.lit(False)), "max_length": F.when(length > 0, length), "pattern": _attr(e, "pattern"), "has_value": _has_value(e), "class_name": _attr(e, "class"), "autocomplete": _attr(e, "autocomplete")}
        own |= {"visible": e["shown"] & ~F.coalesce((_attr(e, "type") == "hidden") | (_attr(e, "aria-hidden") == "true"), F.lit(False)), "disabled": _attr(e, "disabled").isNotNull(), "read_only": _attr(e, "readonly").isNotNull(), "_skip": _input_type(e).isin(*STRUCTURAL) | F.coalesce(held(e), F.lit(False))}
        return F.struct(*[c.alias(n) for n, c in own.items()])

    fields = rows.select("page_id", "frame", F.posexplode(F.transform(F.slice("_fields", 1, MOST_FIELDS), described)).alias("_n", "_f")).select("page_id", "frame", "_n", "_f.*").where("not _skip")
    order = F.row_number().over(Window.partitionBy("page_id").orderBy("frame", "_n", "_key")) - 1
    numbered = fields.withColumn("field_order", order).where(F.col("field_order") < MOST_FIELDS)
    return numbered.withColumn("signature", form_signature(F.col("_key"))).drop("_skip", "_key", "_n")
