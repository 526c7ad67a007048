"""Delivered records of delimited files: valid typed rows on one side, rejects with their reason on the other.

Each row of the input is one undecoded record of a batch; the record with ``line_no`` 1 is the batch's header. The parse
runs in one pass over Arrow batches. Records with a quote mark are first tested for proper quoting, as the CSV reader
itself is lenient there. The rest goes through pyarrow's CSV reader with every field read as a string: rows with another
number of fields come back through the reader's invalid-row callback. The key and flag columns are then tested as whole
vectors, and each failing cell is labelled with its column.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.arrow import bounded
from scriptorium.session import join_small

QUOTING, COLUMN_COUNT, INVALID_VALUE = "quoting", "column_count", "invalid_value"


@dataclass(frozen=True)
class DelimitedSpec:
    """``digits``: column -> number of digits 0-9 its trimmed value must have; ``booleans``: columns whose trimmed value
    must be true or false in any case."""

    digits: dict[str, int] = field(default_factory=dict)
    booleans: tuple[str, ...] = ()
    separator: str = "|"


DATASHEETS = DelimitedSpec(digits={"id": 9})
DATASHEETS_KEYWORDS = DelimitedSpec(digits={"datasheet_id": 9}, booleans=("is_faction_keyword",))


def quoting_pattern(separator: str) -> re.Pattern[str]:
    """Matches a record in which every field that opens with a quote mark is closed right before a separator or the end."""
    s = re.escape(separator)
    one = rf'(?:"(?:[^"]|"")*+"(?={s}|\Z)|[^{s}"][^{s}]*+|(?={s}|\Z))'
    return re.compile(rf"{one}(?:{s}{one})*+\Z")


# Line breaks inside a record are data, but the CSV reader ends a row at an unquoted one, so they travel escaped.
_ESCAPES = (("\x1b", "\x1b0"), ("\n", "\x1b1"), ("\r", "\x1b2"))


def _escape(raw: pa.Array) -> pa.Array:
    for plain, coded in _ESCAPES:
        raw = pc.replace_substring(raw, plain, coded)
    return raw


def _unescape(column: pa.Array) -> pa.Array:
    for plain, coded in reversed(_ESCAPES):
        column = pc.replace_substring(column, coded, plain)
    return column


def _read(raw: list[str], names: list[str], separator: str) -> tuple[pa.Table, dict[int, int]]:
    """The rows that have just these columns, and of each other row its place and number of fields."""
    wrong: dict[int, int] = {}

    def invalid(row: pacsv.InvalidRow) -> str:
        wrong[row.number - 1] = row.actual_columns
        return "skip"

    data = io.BytesIO("\n".join(raw).encode("utf-8", "surrogatepass") + b"\n")
    table = pacsv.read_csv(
        data,
        read_options=pacsv.ReadOptions(use_threads=False, column_names=names, block_size=max(1 << 20, 2 * data.getbuffer().nbytes)),
        parse_options=pacsv.ParseOptions(delimiter=separator, quote_char='"', double_quote=True, newlines_in_values=False, ignore_empty_lines=False, invalid_row_handler=invalid),
        convert_options=pacsv.ConvertOptions(column_types={n: pa.string() for n in names}, strings_can_be_null=False, quoted_strings_can_be_null=False, check_utf8=False),
    )
    return table, wrong


def parse_header(raw: str, separator: str) -> list[str]:
    """Column names without byte-order mark and surrounding blanks; a blank last name is dropped."""
    line = raw.removeprefix("\ufeff").strip("\r\n")
    # ``line`` may quote names like any record
    names = [(_unquote(f)).strip() for f in line.split(separator)] if '"' not in line else [x.strip() for x in _split(line, separator)]
    while names and not names[-1]:
        names.pop()
    return names


def _unquote(value: str) -> str:
    return value[1:-1].replace('""', '"') if len(value) > 1 and value[0] == value[-1] == '"' else value


def _split(line: str, separator: str) -> list[str]:
    s = re.escape(separator)
    return [_unquote(m.group(1)) for m in re.finditer(rf'(?:^|{s})("(?:[^"]|"")*+"(?={s}|\Z)|[^{s}]*)', line)]


def parse_records(raw: pa.Array, header: str | None, spec: DelimitedSpec, with_fields: bool = True) -> tuple[list[str | None], list[str | None], list[dict[str, str] | None]]:
    """For each non-blank record of one batch layout: the reason of its rejection, the failing column, and its fields
    (None for structural rejects). A batch without a header names no column, so its records fail by column count."""
    n = len(raw)
    reasons: list[str | None] = [None] * n
    columns: list[str | None] = [None] * n
    fields: list[dict[str, str] | None] = [None] * n
    names = parse_header(header or "", spec.separator)
    pattern = quoting_pattern(spec.separator)
    for i in pc.indices_nonzero(pc.match_substring(raw, '"')).to_pylist():
        if not pattern.match(raw[i].as_py()):
            reasons[i] = QUOTING
    left = [i for i in range(n) if reasons[i] is None]
    if not names:
        for i in left:
            reasons[i] = COLUMN_COUNT
        return reasons, columns, fields
    # Columns are read by place, as a header may name one twice; the last one of a name counts.
    places = [f"f{k}" for k in range(len(names))]
    escaped = _escape(raw).to_pylist()
    parts: list[tuple[list[int], pa.Table]] = []
    for extra in (0, 1):
        if not left:
            break
        table, wrong = _read([escaped[i] for i in left], places + ["extra"] * extra, spec.separator)
        good = [i for k, i in enumerate(left) if k not in wrong]
        if extra:
            for k in wrong:
                reasons[left[k]] = COLUMN_COUNT
            blank = pc.equal(pc.utf8_trim_whitespace(_unescape(table["extra"].combine_chunks())), "").to_pylist()
            for i, b in zip(good, blank):
                if not b:
                    reasons[i] = COLUMN_COUNT
            keep = [k for k, b in enumerate(blank) if b]
            good, table = [good[k] for k in keep], table.take(keep)
        parts.append((good, table))
        retry = []
        for k, actual in wrong.items():
            if not extra and actual == len(names) + 1:
                retry.append(left[k])
            else:
                reasons[left[k]] = COLUMN_COUNT
        left = sorted(retry)
    for good, table in parts:
        if not good:
            continue
        data = {name: _unescape(table[f"f{k}"].combine_chunks()) for k, name in enumerate(names)}
        bad = pa.array([None] * len(good), pa.string())
        for name, test in [(c, rf"^[0-9]{{{w}}}$") for c, w in spec.digits.items()] + [(c, "^(?i:true|false)$") for c in spec.booleans]:
            if name in data:
                passed = pc.match_substring_regex(pc.utf8_trim(data[name], characters=" \t"), test.replace("^", r"\A").replace("$", r"\z"))
            else:
                passed = pa.array([False] * len(good))
            bad = pc.if_else(pc.and_(pc.is_null(bad), pc.invert(passed)), name, bad)
        for i, column in zip(good, bad.to_pylist()):
            if column is not None:
                reasons[i], columns[i] = INVALID_VALUE, column
        if with_fields:
            cells = [values.to_pylist() for values in data.values()]
            for i, row in zip(good, zip(*cells)):
                fields[i] = dict(zip(data, row))
    return reasons, columns, fields


def parse_delivered(records: DataFrame, spec: DelimitedSpec, with_fields: bool = True) -> DataFrame:
    """Parse delivered records (``line_id, batch_no, line_no, raw``; further columns are ignored).

    Result: ``line_id, batch_no, line_no, reason, failing_column, fields``: one row per record that is neither a header
    (``line_no`` 1) nor blank or null. ``reason`` is null for a valid record, else the first that applies of ``quoting``,
    ``column_count`` and ``invalid_value``; ``failing_column`` names the first failing cell of an ``invalid_value``;
    ``fields`` maps column names to untrimmed strings, null for structural rejects. Records delivered twice stay two
    rows. If a batch has several headers the least one counts; without one, every record fails by ``column_count``.
    An empty table gives an empty result.

    The only shuffle is the one that picks headers; they reach the records by ``join_small``.
    """
    rows = records.select("line_id", "batch_no", "line_no", "raw")
    headers = rows.filter(F.col("line_no") == 1).groupBy("batch_no").agg(F.min("raw").alias("header"))
    # Java's \s with (?U) covers the blanks that Python and Arrow know.
    bodies = rows.filter((F.col("line_no").isNull() | (F.col("line_no") != 1)) & F.col("raw").rlike(r"(?U)[^\s]"))
    joined = join_small(bodies, headers, ["batch_no"], "left")
    schema = "line_id bigint, batch_no int, line_no int, reason string, failing_column string, fields map<string,string>"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "raw"):
            table = pa.table(batch)
            layouts = table["header"].combine_chunks().dictionary_encode()
            codes = pc.fill_null(layouts.indices, -1)
            for code in pc.unique(codes).to_pylist():
                part = table.filter(pc.equal(codes, code))
                header = layouts.dictionary[code].as_py() if code >= 0 else None
                reasons, columns, fields = parse_records(part["raw"].combine_chunks(), header, spec, with_fields)
                maps = [None if f is None else list(f.items()) for f in fields]
                yield pa.RecordBatch.from_arrays(
                    [part[c].combine_chunks() for c in ("line_id", "batch_no", "line_no")]
                    + [pa.array(reasons, pa.string()), pa.array(columns, pa.string()), pa.array(maps, pa.map_(pa.string(), pa.string()))],
                    ["line_id", "batch_no", "line_no", "reason", "failing_column", "fields"],
                )

    return joined.select("line_id", "batch_no", "line_no", "raw", "header").mapInArrow(parse, schema)


def typed_rows(parsed: DataFrame, spec: DelimitedSpec, columns: list[str], others: str | None = None) -> DataFrame:
    """The valid rows with the given columns: flags as BOOLEAN, the others as strings, key columns trimmed. The column named
    ``others`` maps every further name of the record's header to its string."""
    out = [F.col("line_id")]
    for name in columns:
        value = F.try_element_at("fields", F.lit(name))
        trimmed = F.trim(value, F.lit(" \t"))
        if name in spec.booleans:
            value = (F.lower(trimmed) == "true")
        elif name in spec.digits:
            value = trimmed
        out.append(value.alias(name))
    if others:
        out.append(F.map_filter("fields", lambda name, _: ~name.isin(columns)).alias(others))
    return parsed.filter(F.col("reason").isNull()).select(*out)
