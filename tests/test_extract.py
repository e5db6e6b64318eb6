import pytest

from specloom.operators import assemble, extract, material, products

SAMPLE = [
    "\n1403 AB - 33 Rev03\nSprinkleranlegg A10\nTørropplegg for brannvesen / fire department connection\nVåtanlegg sprinkleranlegg\nDelugeanlegg fasade\nNFPA 13\nNFPA 14\nSystemtrykk 12 bar\n",
    "1403.33.332.1.1 Rillede rør for sprinkleranl. Pulverlakkert DN100 m 29,16\n1403.33.332.2.1 Rillerør Bend DN32 stk 188\n1403.33.332.3.1 Fleksibelslange Sprinkleranlegg DN25 stk 386",
    "1403.33.333.1.1 Standard Spray, Nedadrettet, QR K=80, 68°C stk 306\n1403.33.335.1.1 Strømningsvakt stk 6\n1403.33.335.1.2 I/O Enhet Strømningsvakt stk 6",
]
MESSY = "NFPA 13\n1403.33.400.1 Rillede rør for sprinkleranl. Pulverlakkert DN150\nm 1 234,50\nAB12 Klammer DN25 | stk | 42\n2 sett Alarmventil DN100\nBrakett 30 x 40 mm stk 12\nBrannisolering plate m2 45,5\nSum materialer NOK 10 000"
TRACE = "1403.33.331.1 INNENDØRS RØRLEDNINGER - BRANNSLOKKING\n1403.33.331.1 UB1.31994499934A Rillede rør for sprinkleranl. Pulverlakkert DN100 m 29,16"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [("sample", i, i + 1, t) for i, t in enumerate(SAMPLE)] + [("messy", 0, 1, MESSY), ("trace", 0, 3, TRACE), ("blank", 0, 0, None)]
    return extract.normalize_pages(spark.createDataFrame(rows, "doc_id string, page_ord int, page_number int, text string"))


@pytest.fixture(scope="module")
def items(pages):
    return extract.line_items(pages).toPandas()


def test_line_items(items):
    sample = items[items.doc_id == "sample"].sort_values("item_ord")
    assert sample.category.tolist() == ["pipe", "fitting", "hose", "sprinkler", "sensor", "control"]
    assert sample.confidence.tolist() == [99, 99, 99, 99, 91, 91]
    assert set(sample.system) == {"Sprinkleranlegg A10"} and sample.quantity.iloc[0] == 29.16


def test_wrapped_table_and_unknown_rows(items):
    messy = items[items.doc_id == "messy"].sort_values("item_ord")
    assert messy.extraction_method.tolist()[:2] == ["wrapped-line", "table-row"]
    assert messy.quantity.tolist() == [1234.5, 42.0, 2.0, 12.0, 45.5]
    assert messy.category.tolist()[-1] == "unknown" and messy.confidence.tolist()[-1] == 63


def test_trace_row(items):
    row = items[items.doc_id == "trace"].iloc[0]
    assert (row.specification_code, row.section_title, row.confidence) == ("UB1.31994499934A", "INNENDØRS RØRLEDNINGER - BRANNSLOKKING", 97)


@pytest.mark.parametrize("line, quantity, unit, description", [("Rør 4 m2", 2, "m", "Rør 4"), ("lengde rør 25 386 stk", 25386, "stk", "lengde rør"), ("Pipe DN20 pcs 1.234,5", 1234.5, "stk", "Pipe DN20")])
def test_quirks(line, quantity, unit, description):
    got = assemble.parse(line)
    assert (got["quantity"], got["unit"], got["description"]) == (quantity, unit, description)


def test_documents(pages):
    assert sorted(r.code for r in extract.standards(pages).filter("doc_id = 'sample'").collect()) == ["NFPA 13", "NFPA 14"]
    assert extract.systems(pages).filter("doc_id = 'sample'").count() == 4
    codes = {(r.doc_id, r.code) for r in extract.warnings(pages).collect()}
    assert ("blank", "NO_TEXT_EXTRACTED") in codes and ("messy", "UNKNOWN_LINE_ITEMS_INCLUDED") in codes and ("trace", "NO_STANDARDS_DETECTED") in codes


def test_breakdown_balances(pages):
    rows = material.category_breakdown(material.material_lines(extract.line_items(pages))).collect()
    assert all(r.matched + r.missing == r.material_items for r in rows)


def test_products(spark):
    text = '[{"manufacturer": "X", "SIN": 5, "kFactor": [{"value": 2.8, "units": "GPM"}, {"value": 6.1, "units": "LPM/bar"}], "approvals": {"ulListed": true, "fmApproved": true, "ceMark": true}, "temperatureRatings": [{"bulbColor": "Red"}]}, 3]'
    made, wrong = products.normalize(spark.createDataFrame([("a", text), ("b", "{no")], "import_id string, json string"))
    row = made.drop("temperature_ratings", "raw_json").first()
    assert (row.product_no, row.k_value_raw, row.approvals, row.color) == ("5", "2.8 GPM / 61 LPM/bar", "UL, FM, CE", "Red")
    assert {(r.import_id, r.row) for r in wrong.collect()} == {("a", "2"), ("b", "0")}
