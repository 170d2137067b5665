"""URL filters: glob rules as one multiword Shift-And automaton that runs over each canonical URL.

Edge cases: a null url, or one without ``://``, has an empty host and path and matches no rule; repeated
rows are judged alike; ties between fitting rules of one length go to the rule named first; no rules give
the default verdict to all. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import arrow_rows

#: (verdict, rule): host with all its subdomains, then the start of the path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CHUNK_BYTES = 8_000_000


class GlobAutomaton:
    """Anchored globs over bytes: ``?`` is one byte, ``*`` any bytes, ``~`` any bytes other than ``/``.

    Each glob has one bit a state in a row of 64-bit words. A byte c moves the states by
    ``((D << 1) & step[c]) | (D & stay[c])``; stay holds the states before or after a wildcard.
    """

    def __init__(self, globs: Sequence[str]):
        items: list[tuple[int, set[int] | None]] = []
        self.first, self.last, stays = [], [], []
        for glob in globs:
            self.first.append(len(items))
            items.append((len(items), set()))
            for char in glob.encode():
                if char in b"*~":
                    stays.append((len(items) - 1, char == ord("~")))
                else:
                    items.append((len(items), None if char == ord("?") else {char}))
            self.last.append(len(items) - 1)
        self.words = max(1, -(-len(items) // 64))
        self.step = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        for at, chars in items:
            self.step[list(range(256) if chars is None else chars), at // 64] |= self._bit(at)
        for at, in_host in stays:
            self.stay[[c for c in range(256) if not (in_host and c == ord("/"))], at // 64] |= self._bit(at)
        self.start = np.zeros(self.words, np.uint64)
        for at in self.first:
            self.start[at // 64] |= self._bit(at)

    @staticmethod
    def _bit(at: int) -> np.uint64:
        return np.uint64(1 << at % 64)

    def _run(self, matrix: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """matrix: bytes by row, longest rows first."""
        states = np.tile(self.start, (len(matrix), 1))
        live = np.searchsorted(-lengths, -np.arange(matrix.shape[1]), "left")  # rows longer than each position
        for at in range(matrix.shape[1]):
            now = states[: live[at]]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            chars = matrix[: live[at], at]
            states[: live[at]] = (moved & self.step[chars]) | (now & self.stay[chars])
        return states

    def matches(self, texts: Sequence[bytes]) -> np.ndarray:
        """Whether each text (row) fits each glob (column)."""
        out = np.zeros((len(texts), len(self.last)), bool)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-lengths, kind="stable")
        at = 0
        while at < len(order):
            width = max(1, int(lengths[order[at]]))
            part = order[at : at + max(1, CHUNK_BYTES // width)]
            joined = b"".join(texts[i].ljust(width, b"\0") for i in part)
            states = self._run(np.frombuffer(joined, np.uint8).reshape(len(part), width), lengths[part])
            for k, bit in enumerate(self.last):
                out[part, k] = (states[:, bit // 64] & self._bit(bit)) != 0
            at += len(part)
        return out


def glob_of(rule: str) -> str:
    """`host/path` as a glob over `.host/path`: any labels before the host, any end after the path."""
    return f"~.{rule}*"


def filter_urls(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
    rules: Sequence[tuple[str, str]] = RULES, default: str = "allow",
) -> DataFrame:
    """Judges each url by the longest rule that fits; without one the verdict is `default`."""
    rest = F.when(F.instr(F.col(url_col), "://") > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)"))
    parts = pages.select(F.col(id_col).alias("page_id"), F.coalesce(rest, F.lit("")).alias("rest")).select(
        "page_id",
        F.translate(F.regexp_extract("rest", r"^([^/?#]*)", 1), UPPER, LOWER).alias("host"),
        F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"),
    )
    names = [rule for _, rule in rules]
    best_first = sorted(range(len(rules)), key=lambda k: (-len(names[k]), k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = GlobAutomaton([glob_of(n) for n in names])
        schema = pa.schema([("rule", pa.string()), ("verdict", pa.string())])
        for batch in batches:
            urls = [f".{h}{p}".encode() for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            fits = automaton.matches(urls)
            chosen = np.full(len(urls), -1)
            for k in reversed(best_first):
                chosen[fits[:, k]] = k
            said = arrow_rows(schema, [[names[k] if k >= 0 else None for k in chosen], [rules[k][0] if k >= 0 else default for k in chosen]])
            yield pa.RecordBatch.from_arrays([*batch.columns, *said.columns], names=["page_id", "host", "path", "rule", "verdict"])

    key = parts.schema["page_id"].dataType.simpleString()
    return parts.mapInArrow(run, f"page_id {key}, host string, path string, rule string, verdict string")


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP5_SQL = """
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), judged AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/'
  END AS rule FROM parts
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""
