"""Form fields of pages: labels in order of trust, options, values, visibility, frames."""

import time

from lumenfold.functions import markup
from lumenfold.operators.form_fields import detect_fields

PAGE = """<html><body><h1>Apply <b>here</b></h1><form><fieldset><legend>Person</legend>
<label for="n">Full
 name</label><input id="n" name="full" required maxlength="40" value=" ">
<label>Mother <input name="m" type="TEXT" value="x"></label>
<span id="s1">Date</span><span id="s2">of birth</span><input aria-labelledby="s1 no s2" type="date" style="display: none"></fieldset>
<table><tr><td>District<td><select name="d"><option value="">-<option value="1" selected>Gaya<option>Patna</select></table>
<div><p>Village</p><br><textarea name="v">some</textarea></div>
<input type="hidden" name="h"><input type="submit"><input list="dl" name="l" type="checkbox" checked><datalist id="dl"><option value="a"></datalist>
</form><div role="combobox" aria-controls="pop" name="c"><ul role="listbox"><li data-value="9">Nine</li></ul></div><div id="pop"><li>Ten</li></div><div hidden><input name="z" disabled readonly></div><div contenteditable>hi</div></body></html>"""


def test_fields_of_a_page(spark):
    frame = '<input placeholder="p"><script>var t="<input>";</script>'
    pages = spark.createDataFrame([(1, 0, PAGE), (1, 1, frame), (2, 0, None), (3, 0, ""), (4, 0, "<p>no form</p>")], "page_id long, frame int, html string")
    rows = detect_fields(pages).orderBy("page_id", "field_order").collect()
    assert {r.page_id for r in rows} == {1} and [r.field_order for r in rows] == list(range(len(rows)))
    by = {r.name or f"{r.input_type}{r.frame}": r for r in rows}
    assert set(by) == {"full", "m", "date0", "d", "v", "l", "c", "z", "contenteditable0", "text1"}
    assert {k: r.label_text for k, r in by.items() if k not in ("c", "z", "contenteditable0")} == {"full": "Full name", "m": "Mother", "date0": "Date of birth", "d": "District", "v": "Village", "l": "Villagesome", "text1": None}
    assert (by["full"].required, by["full"].max_length, by["full"].has_value, by["m"].has_value, by["m"].input_type) == (True, 40, False, True, "text")
    assert by["full"].section_heading == "Person" and by["c"].section_heading == "Apply here"
    assert [(o.value, o.label) for o in by["d"].options] == [("", "-"), ("1", "Gaya"), ("Patna", "Patna")] and by["d"].has_value and by["v"].has_value
    assert [o.value for o in by["l"].options] == ["a"] and by["l"].has_value
    assert [(o.value, o.label) for o in by["c"].options] == [("9", "Nine"), ("Ten", "Ten")] and (by["c"].tag_name, by["c"].input_type) == ("select", "combobox")
    assert not by["date0"].visible and not by["z"].visible and by["z"].disabled and by["z"].read_only and by["full"].visible
    assert by["text1"].frame == 1 and by["text1"].placeholder == "p" and by["contenteditable0"].has_value
    assert by["v"].nearby_text == "Villagesome"
    assert len({r.signature for r in rows}) == len(rows) and all(r.signature for r in rows)


def test_five_hundred_fields(spark):
    pages = spark.createDataFrame([(1, 0, "<input>" * 600), (1, 1, "<input>" * 3)], "page_id long, frame int, html string")
    assert detect_fields(pages).count() == 500


SHEETS = """<style>.gone, p > i {display:none} /* p {display:none} */ @media print { b {display:none} } @import "x"; #a.k{visibility:hidden!important} div i{opacity:.0} input:hover{display:none} u[data-x^="1"] *, [lang|=de]{display:none}</style>
<p><i><input name=a></i></p><div class="x gone"><input name=b></div><b><input name=c></b><input id=a class=k name=d style="visibility:visible"><u data-x=12><em><input name=g></em></u><u data-x=2><input name=h></u><q lang=de-AT><input name=j></q>
<div id=host><template shadowrootmode="open"><style>input{display:none}</style><label for=q>L</label><input id=q name=s1><div><template shadowrootmode=open><h2>In</h2><input name=s2></template></div></template><input name=e></div>
<template><input name=never></template><div><template shadowrootmode=closed><input name=closed></template></div><div><i><input name=k></i></div><label for=q>Outer</label><input id=q name=f type=checkbox style="opacity:0">"""


def test_style_sheets_and_shadow_roots(spark):
    rows = detect_fields(spark.createDataFrame([(1, 0, SHEETS)], "page_id long, frame int, html string")).orderBy("field_order").collect()
    assert [(r.name, r.visible) for r in rows] == [("a", False), ("b", False), ("c", True), ("d", False), ("g", False), ("h", True), ("j", False), ("e", True), ("k", False), ("f", True), ("s1", False), ("s2", True)]
    by = {r.name: r for r in rows}
    assert by["s1"].label_text == "Outer" and by["f"].label_text == "Outer" and by["s2"].label_text == "In" and by["s2"].section_heading is None and by["e"].section_heading is None


def test_deep_pages_take_linear_time():
    began = time.process_time()
    found = [markup.elements("<div>\n" * 16_000 + "<input>"), markup.elements("".join(f"<b id=x{i}>t " for i in range(8_000))), markup.elements("<style>" + "".join(f".c{i} .d{i}{{display:none}}" for i in range(500)) + "</style>" + "".join(f"<div class='c{i % 700}'><i class='d{i % 700}'>" for i in range(8_000)))]
    assert [len(x) for x in found] == [16_001, 8_000, 16_001] and time.process_time() - began < 6
    assert found[0][-1]["ancestors"] == list(range(15_999, 15_991, -1)) and markup.elements("a<template><b>")[:1] == []
