"""URL filters: rules on hosts and paths, then glob patterns run as one bit-parallel automaton."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.llm import textkit as K

# Given by the contract: (verdict, host, path). A rule fits its host and all subdomains, if the path starts with the rule's.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
# Own choice, defaults of a parameter: globs over the canonical URL; * is any run of characters, ? is any one.
BLOCK_GLOBS = ["*://*spam*/*", "*://*free-bets*/*", "*://*casino*/*", "*://*poker*/*", "*://*porn*/*", "*://*xxx*/*", "*://adult?*/*", "*/login*", "*.exe", "*.zip", "*/cgi-bin/*", "*\\?*sessionid=*"]
ALLOW_GLOBS = ["*://*/robots.txt", "*://*/about*"]
FURTHER = set(range(0x80, 0xC0))  # bytes of a character behind its first
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Globs:
    """All patterns in one Shift-And automaton over several 64-bit words, for many texts at once.

    Each pattern has a start bit and one bit per byte of a character, one for a ?. Bits behind which a * follows stay set
    whatever comes, those of a ? through the further bytes of its character. A backslash takes the next character as it is.
    """

    def __init__(self, patterns: list[str]):
        masks, loops, any_one, starts, finals = [], [], [], [], []
        for p in patterns:
            start = len(masks)
            masks.append(set())
            loops.append(False)
            i, raw = 0, p.encode()
            while i < len(raw):
                c = raw[i]
                if c == 0x2A:
                    loops[-1] = True
                else:
                    literal = c == 0x5C and i + 1 < len(raw)
                    i += literal
                    if c == 0x3F:
                        any_one.append(len(masks))
                    masks.append(set(range(256)) - FURTHER if c == 0x3F else {raw[i]})
                    loops.append(False)
                i += 1
            starts.append(start)
            finals.append(len(masks) - 1)
        self.words = (len(masks) + 63) // 64 or 1
        self.on = np.zeros((256, self.words), np.uint64)
        for bit, chars in enumerate(masks):
            for c in chars:
                self.on[c, bit >> 6] |= np.uint64(1 << (bit & 63))
        self.loop = self._bits([b for b, x in enumerate(loops) if x])
        self.one = self._bits(any_one)
        self.start = self._bits(starts)
        self.finals = finals

    def _bits(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for b in bits:
            out[b >> 6] |= np.uint64(1 << (b & 63))
        return out

    def match(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, patterns): whether the whole text fits the pattern."""
        n = len(offsets) - 1
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        begin, live = offsets[:-1][order], n
        state = np.tile(self.start, (n, 1))
        falling = -lengths[order]
        for t in range(int(lengths.max(initial=0))):
            live = int(np.searchsorted(falling, -t, "left"))  # texts longer than t come first
            s = state[:live]
            moved = s << np.uint64(1)
            moved[:, 1:] |= s[:, :-1] >> np.uint64(63)
            byte = data[begin[:live] + t]
            moved &= self.on[byte]
            further = np.where((byte & 0xC0) == 0x80, s.T & self.one[:, None], np.uint64(0)).T
            state[:live] = moved | (s & self.loop) | further
        out = np.zeros((n, len(self.finals)), bool)
        for k, f in enumerate(self.finals):
            out[order, k] = (state[:, f >> 6] >> np.uint64(f & 63)) & np.uint64(1) > 0
        return out


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Scheme and host in lower case, the path (/ if none), the query; no fragment. Empty without a host."""
    scheme = F.translate(F.regexp_extract(url, r"(?s)^(.*?)://", 1), UPPER, LOWER)
    path = path_of(url)
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    whole = F.concat(scheme, F.lit("://"), host_of(url), F.when(path == "", "/").otherwise(path), query)
    return F.when(host_of(url) == "", "").otherwise(F.coalesce(whole, F.lit("")))


def _fits(rule: tuple[str, str, str]) -> Column:
    _, host, path = rule
    return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, block=BLOCK_GLOBS, allow=ALLOW_GLOBS) -> DataFrame:
    """One row per input row: the id, host, path, canonical, the longest rule that fits (as host and path; else null),
    and the verdict: the rule's, else block if a block glob fits the canonical URL and no allow glob does, else allow.

    A null URL or one without :// has an empty host and path, fits nothing and is allowed. Repeated rows give repeated
    results; other columns are not read; an empty table gives no rows. Very long URLs are read whole. No shuffle.
    """
    automaton = Globs([*block, *allow])
    split = len(block)
    u = F.col(url_col)
    rows = pages.select(F.col(id_col), host_of(u).alias("host"), path_of(u).alias("path"), canonical(u).alias("canonical"))
    schema = T.StructType([*rows.schema.fields, T.StructField("globbed", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for _, _, data, offsets in K.chunks(b.column(3)):
                hit = automaton.match(data, offsets)
                parts.append(hit[:, :split].any(axis=1) & ~hit[:, split:].any(axis=1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(parts) if parts else np.zeros(0, bool))], names=schema.names)

    judged = rows.mapInArrow(run, schema)
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("globbed"), "block").otherwise("allow")
    for r in sorted(rules, key=lambda r: len(r[1] + r[2])):
        rule = F.when(_fits(r), r[1] + r[2]).otherwise(rule)
        verdict = F.when(_fits(r), r[0]).otherwise(verdict)
    return judged.select(id_col, "host", "path", "canonical", rule.alias("rule"), verdict.alias("verdict"))


def _like(glob: str) -> str:
    """A glob as a regular expression over the whole text."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "\\":
            i += 1
            c = "\\" + glob[i]
        elif c == "*":
            c = ".*"
        elif c == "?":
            c = "."
        elif not c.isalnum() and c not in "/:-_=":
            c = "\\" + c
        out += c
        i += 1
    return out


def _any(globs: list[str]) -> str:
    return f"regexp_full_match(canonical, '{'|'.join(map(_like, globs))}', 's')"


_R = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
_CASE = [f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN" for _, h, p in _R]
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*(\\?[^#]*)', 1), '') AS query,
    translate(regexp_extract(url, '(?s)^(.*?)://', 1), '{UPPER}', '{LOWER}') AS scheme FROM pages),
c AS (SELECT *, CASE WHEN host = '' THEN '' ELSE scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || query END AS canonical FROM p)
SELECT page_id, host, path, canonical, CASE {' '.join(f"{c} '{h}{p}'" for c, (_, h, p) in zip(_CASE, _R, strict=True))} END AS rule,
  CASE {' '.join(f"{c} '{v}'" for c, (v, _, _) in zip(_CASE, _R, strict=True))}
    WHEN {_any(BLOCK_GLOBS)} AND NOT {_any(ALLOW_GLOBS)} THEN 'block' ELSE 'allow' END AS verdict FROM c"""
