"""Secret scans over an incremental ledger of blobs.

Every version of every path is content-addressed (SHA-256 of its text). The ledger is a table of the
(blob, rule version) pairs scanned so far with their findings. A scan takes only the pairs the ledger
lacks, each blob once however many paths and versions hold it, appends them, and joins the findings
back to all paths. Rules are patterns in the text, by code points.

Cases: a null text is an empty blob; null paths and repeated rows keep their rows; an empty table adds
nothing to the ledger and gives no rows; other columns of the input pass through, those named ``blob``
or ``spans`` are replaced. A copied blob, however hot, is one row before any text is shuffled (the
distinct is combined on the map side) and one row in the ledger.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookheat.llm.common import chunks, lean, other_columns, row_of, unpacked, with_row
from bookheat.session import scratch_path

#: Kinds in their listed order; the first three are the base rules.
KINDS = ("assign", "access", "hex", "private_key", "code_host_token", "web_token")
BASE = KINDS[:3]
RULES_VERSION = "4"
SPANS = "array<struct<kind:string,start:long,end:long>>"
_LEDGER = f"blob string, rule_version string, spans {SPANS}"

_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
# A run of 16 (or 32) and more from the leftmost start is the run that '+' finds and the length admits.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_MORE = {
    "code_host_token": re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
    "web_token": re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
}
_HINTS = {"code_host_token": "gh", "web_token": "eyJ"}
_KEY_MARK = re.compile(r"-----(BEGIN|END) ((?:[A-Z]+ )*PRIVATE KEY)-----")
_KEY_LINE = re.compile(r"[A-Za-z0-9+/=]*|[A-Za-z][A-Za-z-]*: [\x20-\x7E]*")


def _key_blocks(text: str) -> Iterator[tuple[int, int]]:
    """From an opening mark to the next mark, if that closes the same label and only key lines lie between, in one pass.

    Key lines are blank, ``Name: value`` headers or base64, of any number.
    """
    begin = None
    for m in _KEY_MARK.finditer(text):
        if m[1] == "END" and begin and begin[2] == m[2]:
            lines = [x.strip() for x in text[begin.end() : m.start()].replace("\\n", "\n").split("\n")]
            if any(lines) and all(_KEY_LINE.fullmatch(x) for x in lines):
                yield begin.start(), m.end()
        begin = m if m[1] == "BEGIN" else None


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place, end) of every span of one text, ordered by start, then kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if "-----BEGIN " in text:
        out += [(a, KINDS.index("private_key"), b) for a, b in _key_blocks(text)]
    for kind, hint in _HINTS.items():
        if hint in text:
            out += [(m.start(), KINDS.index(kind), m.end()) for m in _MORE[kind].finditer(text)]
    return sorted(out)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in chunks(batches, "_text"):
        found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in find(t)] for t in batch.column("_text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("blob"), batch.column("rule_version"), pa.array(found, kind)], ["blob", "rule_version", "spans"]
        )


def address(versions: DataFrame, text: str = "text") -> DataFrame:
    """``versions`` with ``blob``, the content address of each text."""
    return versions.withColumn("blob", F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def read_ledger(versions: DataFrame, ledger: str) -> DataFrame:
    """The ledger at ``ledger``, created empty if it is not there."""
    spark = versions.sparkSession
    spark.createDataFrame([], _LEDGER).write.mode("append").parquet(ledger)
    return spark.read.schema(_LEDGER).parquet(ledger)


def update_ledger(versions: DataFrame, ledger: str, rule_version: str = RULES_VERSION, text: str = "text") -> None:
    """Scan the blobs of ``versions`` that the ledger lacks under ``rule_version``; append them."""
    seen = read_ledger(versions, ledger).filter(F.col("rule_version") == rule_version).select("blob")
    blobs = address(versions, text).select("blob", F.coalesce(F.col(text), F.lit("")).alias("_text"))
    unseen = blobs.join(seen, "blob", "left_anti").groupBy("blob").agg(F.first("_text").alias("_text"))
    unseen.withColumn("rule_version", F.lit(rule_version)).mapInArrow(lean(_scan), _LEDGER).write.mode("append").parquet(ledger)


def findings(versions: DataFrame, ledger: str | None = None, rule_version: str = RULES_VERSION, text: str = "text") -> DataFrame:
    """``versions`` with ``blob`` and ``spans``; scans first what the ledger lacks.

    Without ``ledger`` a fresh one in the shared folder is used.
    """
    ledger = ledger or scratch_path(versions.sparkSession, "blob-ledger")
    update_ledger(versions, ledger, rule_version, text)
    known = read_ledger(versions, ledger).filter((F.col("rule_version") == rule_version) & (F.size("spans") > 0))
    known = known.groupBy("blob").agg(F.first("spans").alias("spans"))
    named = address(versions.drop("spans"), text)
    return named.join(known, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPANS)))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def of_kinds(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "_text"):
        out = []
        for text, spans in zip(batch.column("_text").to_pylist(), batch.column("spans").to_pylist()):
            if text is not None and spans:
                parts, at = [], 0
                for s in sorted(spans, key=lambda s: s["start"]):
                    if s["end"] > at:
                        parts += [text[at : max(at, s["start"])], f"[{s['kind'].upper()}]" if s["start"] >= at else ""]
                        at = s["end"]
                text = "".join(parts) + text[at:]
            out.append(text)
        names = [n for n in batch.schema.names if n not in ("_text", "spans")]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, pa.string())], [*names, "_text"])


def redact(versions: DataFrame, ledger: str | None = None, text: str = "text") -> DataFrame:
    """``versions`` with every span of ``text`` replaced by its kind in square brackets."""
    others = other_columns(versions, text)
    found = findings(versions.select(row_of(others).alias("_row"), F.col(f"`{text}`").alias("_text")), ledger, text="_text")
    out = found.select("_row", "_text", "spans").mapInArrow(lean(_redact), with_row(versions, others, "_text string", "_row"))
    columns = dict(zip(others, unpacked(others, "_row")))
    return out.select(*[columns.get(c, F.col("_text").alias(c)) for c in versions.columns])
