import pytest
from pyspark.sql import functions as F

from scriptorium.operators import delimited as D

SCHEMA = "line_id bigint, batch_no int, line_no int, raw string, extra string, fields string"


def reference(raw, names, key, digits, flag=None):
    """Character by character, as the format is defined."""
    if raw is None or not raw.strip():
        return "blank"
    out, i = [], 0
    while True:
        if i < len(raw) and raw[i] == '"':
            j, cell = i + 1, ""
            while True:
                if j >= len(raw):
                    return "quoting"
                if raw[j] == '"' and raw[j + 1 : j + 2] == '"':
                    cell, j = cell + '"', j + 2
                elif raw[j] == '"':
                    break
                else:
                    cell, j = cell + raw[j], j + 1
            j += 1
            if j < len(raw) and raw[j] != "|":
                return "quoting"
        else:
            j = raw.find("|", i) if "|" in raw[i:] else len(raw)
            cell = raw[i:j]
        out.append(cell)
        if j >= len(raw):
            break
        i = j + 1
    if len(out) != len(names) and not (len(out) == len(names) + 1 and not out[-1].strip()):
        return "column_count"
    row = dict(zip(names, out))
    value = row.get(key, "").strip(" \t")
    if len(value) != digits or any(c not in "0123456789" for c in value):
        return "invalid_value"
    if flag and row.get(flag, "").strip(" \t").lower() not in ("true", "false"):
        return "invalid_value"
    return None


RECORDS = [
    "000000001|Swift|true", '"000000001"|"a|b"|"TRUE"', '000000001|"a""b"|false', '000000001|"open|true', '000000001|"x"y|true', "000000001|mid\"dle|true",
    "000000001|two\nlines|true", "000000001|cr\r\nlf|true", '000000001|"q\nq"|true', "000000001|a|true|", "000000001|a|true|  ", "000000001|a|true|x", "000000001|a|true||",
    "000000001|a", "00000001|a|true", "00000000a|a|true", " \t000000001 |a|\ttrue ", "000000001|a|yes", "000000001|a|", "|a|true", "", "   ", None, "\n", '""|a|true',
    '000000001|"a" |true', "٠٠٠٠٠٠٠٠١|a|true", "000000001|\x1b0|true", "000000001|" + "x" * 300_000 + "|true", '000000001|"' + '""' * 40_000 + '"|true', "|||", '"', '"|"|"',
    "000000001|a|true|\" \"", "000000001|a|TrUe", "000000001|nan|true",
]


@pytest.mark.parametrize("header", ["datasheet_id|keyword|is_faction_keyword|", "﻿datasheet_id|keyword|is_faction_keyword"])
def test_every_kind_of_record(spark, header):
    rows = [(0, 1, 1, header, "e", "f")] + [(i + 1, 1, i + 2, r, None, None) for i, r in enumerate(RECORDS)]
    got = {r.line_id: r for r in D.parse_delivered(spark.createDataFrame(rows, SCHEMA), D.DATASHEETS_KEYWORDS).collect()}
    want = {i + 1: reference(r, ["datasheet_id", "keyword", "is_faction_keyword"], "datasheet_id", 9, "is_faction_keyword") for i, r in enumerate(RECORDS)}
    assert {k: v.reason for k, v in got.items()} == {k: v for k, v in want.items() if v != "blank"}
    assert got[7].fields["keyword"] == "two\nlines" and got[8].fields["keyword"] == "cr\r\nlf" and got[3].fields["keyword"] == 'a"b'
    assert got[28].fields["keyword"] == "\x1b0" and got[4].fields is None and got[18].failing_column == "is_faction_keyword"


def test_layouts_missing_headers_and_empty_tables(spark):
    rows = [
        (1, 1, 1, "keyword|is_faction_keyword|datasheet_id", None, None), (2, 1, 2, "a|true|000000001", None, None),
        (3, 2, 2, "000000001|a|true", None, None), (4, 3, 1, "a|b", None, None), (5, 3, 2, "x|y", None, None), (6, None, 5, "x|y", None, None), (7, 1, None, "b|false|000000002", None, None), (2, 1, 2, "a|true|000000001", None, None),
    ]
    parsed = D.parse_delivered(spark.createDataFrame(rows, SCHEMA), D.DATASHEETS_KEYWORDS)
    assert sorted((r.line_id, r.reason) for r in parsed.filter("reason is not null").collect()) == [(3, "column_count"), (5, "invalid_value"), (6, "column_count")]
    typed = D.typed_rows(parsed, D.DATASHEETS_KEYWORDS, ["datasheet_id", "keyword", "is_faction_keyword"])
    assert sorted(map(tuple, typed.collect())) == [(2, "000000001", "a", True), (2, "000000001", "a", True), (7, "000000002", "b", False)]
    assert D.parse_delivered(spark.createDataFrame([], SCHEMA), D.DATASHEETS).count() == 0


def test_many_headers_are_joined_by_salt(spark):
    from scriptorium.session import join_small

    left = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    right = spark.range(7).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    small, salted = (join_small(left, right, ["k"], "left", max_rows=n).orderBy("id").collect() for n in (100, 3))
    assert small == salted and len(small) == 1000


def test_valid_datasheets_keep_every_column(spark, tmp_path):
    from scriptorium.plans.catalogue import QUERIES

    names = ["id", "name", "faction_id", "source_id", "role", "loadout", "transport", "leader_head", "leader_footer", "damaged_w", "damaged_description", "virtual"]
    cells = ["000000001", *(f" {n} " for n in names[1:])]
    rows = [
        (1, 1, 1, "|".join(names[::-1]) + "|", None, None), (2, 1, 2, "|".join(cells[::-1]) + "|", None, None),
        (3, 2, 1, "|".join([*names, "legend", "link"]), None, None), (4, 2, 2, "|".join([*cells, "old", ""]), None, None),
    ]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "datasheets_csv.parquet"))
    got = {r.line_id: r for r in QUERIES["p1_valid_datasheets"](spark, str(tmp_path)).collect()}
    assert [got[2][n] for n in names] == [got[4][n] for n in names] == cells
    assert got[2].others == {} and got[4].others == {"legend": "old", "link": ""}
