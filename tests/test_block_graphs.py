"""Block graphs are resolved within the row of their response."""

import json

from pyspark.sql import functions as F

from tallysheet.sources import layouts


def _block(id_, kind, text=None, child=(), value=(), **more):
    return {"Id": id_, "BlockType": kind, "Text": text, "Page": 2,
            "Relationships": [{"Type": "CHILD", "Ids": list(child)}, {"Type": "VALUE", "Ids": list(value)}], **more}


def _responses(spark, blocks):
    return spark.createDataFrame(
        [("d", json.dumps({"Blocks": blocks})), ("none", "{}"), ("bad", "not json")], "document_id string, response string")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_of_a_table_of_many_words(spark):
    count = 3 * layouts.INDEX_LIST + 7
    cells = [_block(f"c{i}", "CELL", child=[f"w{i}", "gone", f"s{i}"], RowIndex=i + 1, ColumnIndex=1, Confidence=88.0,
                    **({"EntityTypes": ["COLUMN_HEADER"]} if i == 0 else {})) for i in range(count)]
    words = [_block(f"w{i}", "WORD", f" word {i} ") for i in range(count)]
    marks = [_block(f"s{i}", "SELECTION_ELEMENT", SelectionStatus="SELECTED" if i % 2 else "NOT_SELECTED") for i in range(count)]
    own = _block("own", "CELL", " Own :", child=["w1"], RowIndex=1, ColumnIndex=2)
    empty = _block("empty", "CELL", RowIndex=1, ColumnIndex=3)
    unplaced = _block("unplaced", "CELL", child=["w1"])
    table = _block("t", "TABLE", child=[*[f"c{i}" for i in range(count)], "own", "empty", "unplaced", "gone"])
    found = layouts.read_block_tables(_responses(spark, [*words, *cells, own, empty, unplaced, *marks, table]))
    assert "Exchange" not in _plan(found)
    rows = {(r.row_index, r.column_index): r for r in found.collect()}
    assert len(rows) == count + 2
    for i in range(count):
        assert rows[i + 1, 1].text == (f"word {i} X" if i % 2 else f"word {i}")
    assert (rows[1, 2].text, rows[1, 3].text) == ("Own", "")
    assert rows[1, 1].is_header is True and rows[2, 1].is_header is False
    assert {(r.document_id, r.provider_pct, r.page) for r in rows.values()} == {("d", 88, 2), ("d", None, 2)}


def test_keys_and_values_of_a_form(spark):
    blocks = [
        _block("w1", "WORD", "Name:"), _block("w2", "WORD", "Ada"), _block("sig", "SIGNATURE"),
        _block("k1", "KEY_VALUE_SET", child=["w1"], value=["gone", "v1"], EntityTypes=["KEY"]),
        _block("v1", "KEY_VALUE_SET", child=["w2", "sig"], EntityTypes=["VALUE"], Confidence=91.4),
        _block("k2", "KEY_VALUE_SET", child=["gone"], value=["v1"], EntityTypes=["KEY"]),
        _block("k3", "KEY_VALUE_SET", "Lone", EntityTypes=["KEY"]),
    ]
    found = layouts.read_block_pairs(_responses(spark, blocks))
    assert "Exchange" not in _plan(found)
    assert sorted((r.item, r.key, r.value, r.confidence_pct, r.page) for r in found.collect()) == [
        (3, "Name", "Ada signed", 91, 2), (6, "Lone", "", 74, 2)]


def test_responses_are_parsed_once(spark):
    pairs = {"analyzeResult": {"keyValuePairs": [{"key": {"content": "a"}, "value": {"content": "b"}}]}}
    responses = spark.createDataFrame([("d", json.dumps(pairs)), ("none", "{}")], "document_id string, response string")
    readers = (layouts.read_listed_pairs, layouts.blocks, layouts.read_ready_rows, layouts.read_cell_tables,
               layouts.read_anchor_tables, layouts.read_suggestions)
    for read in readers:
        assert _plan(read(responses.withColumn("response", F.concat("response", F.lit(" "))))).count("from_json") == 1
    assert [(r.document_id, r.key, r.value) for r in layouts.read_listed_pairs(responses).collect()] == [("d", "a", "b")]


def test_words_are_nested_or_flat(spark):
    box = {"vertices": [{"x": 1, "y": 2}, {"x": 4, "y": 6}]}
    flat = [{"description": "all", "boundingPoly": box}, {"description": "F", "boundingPoly": box}]
    nested = [{"blocks": [{"paragraphs": [{"words": [{"symbols": [{"text": "a"}, {"text": "b"}], "boundingBox": box}]}]}]}]
    make = lambda pages, listed: json.dumps({"responses": [{"fullTextAnnotation": {"pages": pages}, "textAnnotations": listed}]})
    responses = spark.createDataFrame(
        [("n", make(nested, flat)), ("f", make([], flat)), ("g", make(None, flat)), ("none", "{}")], "document_id string, response string")
    found = layouts.read_word_boxes(responses).collect()
    assert sorted((r.document_id, r.word, r.text, r.width, r.confidence_pct) for r in found) == [
        ("f", 0, "F", 3.0, 72), ("g", 0, "F", 3.0, 72), ("n", 0, "ab", 3.0, 82)]
