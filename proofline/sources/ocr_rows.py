"""Tab-separated OCR rows: load the valid ones into typed columns, set the broken ones aside.

Input is one row per line of a recognised page file.  Line 1 of a file names its columns, whose
number and order vary.  Structure is judged by the Arrow CSV reader: every batch is split by layout
and parsed once, and rows of a wrong width reach its invalid-row callback.  Fields are read as
strings and then judged cell by cell with vectorised kernels, so one bad cell never fails a load.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pcsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The columns of the OCR table format, in their usual order.
COUNT_COLUMNS = ["page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height"]
STANDARD_COLUMNS = ["level", *COUNT_COLUMNS, "conf", "text"]

QUOTING, COLUMN_COUNT, VALUE = "quoting", "column_count", "value"

TYPED_SCHEMA = (
    "raw_id long, pdf string, page int, line_no int, level int, "
    + ", ".join(f"{c} long" for c in COUNT_COLUMNS)
    + ", conf double, text string, extra map<string,string>, reason string"
)

_FIELD = r'(?:"[^"]*(?:""[^"]*)*"|[^"\t]*)'
_WELL_QUOTED = rf"^{_FIELD}(?:\t{_FIELD})*$"
_OUT = pa.schema(
    [("raw_id", pa.int64()), ("pdf", pa.string()), ("page", pa.int32()), ("line_no", pa.int32()), ("level", pa.int32())]
    + [(c, pa.int64()) for c in COUNT_COLUMNS]
    + [("conf", pa.float64()), ("text", pa.string()), ("extra", pa.map_(pa.string(), pa.string())), ("reason", pa.string())]
)


def _parse(lines: pa.Array, width: int, quoted: bool) -> tuple[pa.Table, dict[int, int]]:
    """Fields of the lines of ``width`` columns, and {position: columns found} of all others."""
    wrong: dict[int, int] = {}

    def invalid(row: pcsv.InvalidRow) -> str:
        wrong[row.number - 1] = row.actual_columns
        return "skip"

    text = "\n".join(lines.to_pylist()).encode() + b"\n"
    names = [f"c{i}" for i in range(width)]
    parsed = pcsv.read_csv(
        pa.BufferReader(text),
        read_options=pcsv.ReadOptions(use_threads=False, block_size=len(text) + 1, column_names=names),
        parse_options=pcsv.ParseOptions(
            delimiter="\t", quote_char='"' if quoted else False, double_quote=True, ignore_empty_lines=False, invalid_row_handler=invalid
        ),
        convert_options=pcsv.ConvertOptions(column_types={n: pa.string() for n in names}, strings_can_be_null=False),
    )
    return parsed, wrong


def _matches(cells: pa.Array, pattern: str) -> pa.Array:
    return pc.fill_null(pc.match_substring_regex(cells, pattern), False)


def _typed(rows: pa.Table, names: list[str], fields: pa.Table) -> pa.Table:
    """Cast the parsed fields of rows that have the right width, labelling rows with an impossible cell."""
    n = len(rows)
    first = {name: i for i, name in reversed(list(enumerate(names)))}
    ok = pa.array([True] * n)
    cast: dict[str, pa.Array] = {}

    def cells(name: str) -> pa.Array | None:
        i = first.get(name)
        if i is None or i >= fields.num_columns:
            return None
        return pc.cast(fields.column(i).combine_chunks(), pa.string())

    for name in ["level", *COUNT_COLUMNS, "conf"]:
        kind = _OUT.field(name).type
        x = cells(name)
        if x is None:
            cast[name] = pa.nulls(n, kind)
            continue
        if name == "level":
            good = _matches(x, r"^[1-5]$")
            fits = good
        elif name == "conf":
            good = _matches(x, r"^(?:-1|[0-9]+(?:\.[0-9]+)?)$")
            number = pc.cast(pc.if_else(good, x, pa.scalar(None, pa.string())), pa.float64())
            good = pc.fill_null(pc.less_equal(number, 100.0), False)
            fits = good
        else:
            good = _matches(x, r"^[0-9]+$")
            fits = _matches(x, r"^0*[0-9]{1,18}$")
        cast[name] = pc.cast(pc.if_else(fits, x, pa.scalar(None, pa.string())), kind)
        ok = pc.and_(ok, good)
    text = cells("text")
    cast["text"] = pa.nulls(n, pa.string()) if text is None else text
    others = [(name, i) for name, i in first.items() if name not in STANDARD_COLUMNS and i < fields.num_columns]
    if others:
        columns = [fields.column(i).to_pylist() for _, i in others]
        cast["extra"] = pa.array([list(zip([o[0] for o in others], row)) for row in zip(*columns)], _OUT.field("extra").type)
    else:
        cast["extra"] = pa.nulls(n, _OUT.field("extra").type)
    cast["reason"] = pc.if_else(ok, pa.scalar(None, pa.string()), pa.scalar(VALUE))
    return pa.table([rows.column(c) if c in ("raw_id", "pdf", "page", "line_no") else cast[c] for c in _OUT.names], schema=_OUT)


def _rejected(rows: pa.Table, reason: str) -> pa.Table:
    n = len(rows)
    columns = [rows.column(f.name) if f.name in ("raw_id", "pdf", "page", "line_no") else pa.nulls(n, f.type) for f in _OUT][:-1]
    return pa.table([*columns, pa.array([reason] * n, pa.string())], schema=_OUT)


def _marks(lines: pa.Array) -> dict[str, str]:
    """Signs for the two line breaks that none of ``lines`` has."""
    used = set("".join(lines.to_pylist()))
    free = (chr(c) for c in (*range(0xE000, 0xF900), *range(0xF0000, 0xFFFFE), *range(0x100000, 0x10FFFE)) if chr(c) not in used)
    return {"\n": next(free), "\r": next(free)}


def _restore(table: pa.Table, marks: dict[str, str]) -> pa.Table:
    if not marks:
        return table
    text, extra = table.column("text"), table.column("extra").to_pylist()
    for plain, mark in marks.items():
        text = pc.replace_substring(text, mark, plain)
        extra = [x if x is None else [(k, None if v is None else v.replace(mark, plain)) for k, v in x] for x in extra]
    table = table.set_column(table.column_names.index("text"), "text", text)
    return table.set_column(table.column_names.index("extra"), "extra", pa.array(extra, _OUT.field("extra").type))


def _layout(rows: pa.Table, names: list[str], quoted: bool) -> Iterator[pa.Table]:
    """Judge the rows of one batch that share a header and a dialect."""
    lines = rows.column("line").combine_chunks()
    if quoted:
        good = _matches(lines, _WELL_QUOTED)
        if not pc.all(good).as_py():
            yield _rejected(rows.filter(pc.invert(good)), QUOTING)
            rows = rows.filter(good)
            lines = rows.column("line").combine_chunks()
    if not len(rows):
        return
    marks = _marks(lines) if pc.any(_matches(lines, r"[\r\n]")).as_py() else {}
    for plain, mark in marks.items():  # a line break inside a stored line is data, not a new row
        lines = pc.replace_substring(lines, plain, mark)
    fields, wrong = _parse(lines, len(names), quoted)
    right = rows
    if wrong:
        at = sorted(wrong)
        right = rows.filter(pc.invert(pc.is_in(pa.array(range(len(rows))), pa.array(at))))
        short = [i for i in at if wrong[i] == len(names) - 1 and names[-1] == "text" and len(names) > 1]
        bad = [i for i in at if i not in set(short)]
        if short:  # a row of a page, block, paragraph or line has no text; its file may end it early
            parsed, _ = _parse(lines.take(pa.array(short)), len(names) - 1, quoted)
            level = names.index("level") if "level" in names[:-1] else None
            lacks = [level is not None and v in {"1", "2", "3", "4"} for v in (parsed.column(level).to_pylist() if level is not None else short)]
            keep = pa.array(lacks, pa.bool_())
            if any(lacks):
                yield _restore(_typed(rows.take(pa.array(short)).filter(keep), names, parsed.filter(keep)), marks)
            bad += [i for i, k in zip(short, lacks) if not k]
        if bad:
            yield _rejected(rows.take(pa.array(sorted(bad))), COLUMN_COUNT)
    if len(right):
        yield _restore(_typed(right, names, fields), marks)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        line = rows.column("line")
        blank = pc.fill_null(pc.equal(pc.utf8_trim_whitespace(line), ""), True)
        done = [_rejected(rows.filter(blank), COLUMN_COUNT)] if pc.any(blank).as_py() else []
        rows = rows.filter(pc.invert(blank))
        if len(rows):
            key = pc.binary_join_element_wise(rows.column("dialect"), rows.column("header"), "\x00")
            for k in pc.unique(key).to_pylist():
                dialect, _, header = k.partition("\x00")
                done.extend(_layout(rows.filter(pc.equal(key, k)), header.split("\t"), dialect == "quoted"))
        for table in done:
            yield from table.to_batches()


def judge_ocr_rows(raw: DataFrame) -> DataFrame:
    """Every data row of ``raw`` in typed columns, with the ``reason`` it fails or null if it is valid.

    ``raw`` has raw_id, pdf, page, line_no, dialect and raw_line; other columns are ignored.  Rows
    repeated under one raw_id come out once.  Reasons, the first that applies: ``quoting`` (dialect
    ``quoted`` only), ``column_count`` (wrong width, or a null, empty or blank line), ``value``
    (impossible level, count or confidence).  A file without a header line is read with the standard
    columns; an unknown or null dialect counts as ``plain``.  Counts beyond 18 digits are valid but
    have no typed value.  Columns outside the format are kept as text in the map ``extra``.  The two
    line ends the format allows (a final carriage return, a byte-order mark before a header) are no
    part of a row.  An empty table gives an empty result.

    Headers are joined by (pdf, page), so one very long pdf still spreads over its pages; the join is
    broadcast only if Spark measures the header side to be below its size limit.
    """
    line = F.regexp_replace("raw_line", r"\r\z", "")
    rows = raw.select("raw_id", "pdf", "page", "line_no", F.coalesce("dialect", F.lit("plain")).alias("dialect"), line.alias("line"))
    headers = (
        rows.where("line_no = 1")
        .groupBy(F.col("pdf").alias("h_pdf"), F.col("page").alias("h_page"))
        .agg(F.min(F.regexp_replace("line", "^\\x{FEFF}", "")).alias("header"))
    )
    standard = "\t".join(STANDARD_COLUMNS)
    data = (
        rows.where("line_no is null or line_no <> 1")
        .join(headers, F.col("pdf").eqNullSafe(F.col("h_pdf")) & F.col("page").eqNullSafe(F.col("h_page")), "left")
        .select("raw_id", "pdf", "page", "line_no", "dialect", "line", F.coalesce("header", F.lit(standard)).alias("header"))
    )
    judged = data.mapInArrow(_judge, TYPED_SCHEMA)
    return judged


def load_ocr_rows(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows in typed columns, failing rows as raw_id and reason), each row once."""
    judged = judge_ocr_rows(raw)
    valid = judged.where("reason is null").drop("reason").dropDuplicates(["raw_id"])
    rejects = judged.where("reason is not null").select("raw_id", "reason").distinct()
    return valid, rejects
