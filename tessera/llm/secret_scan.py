"""Secret scans: fixed patterns, and a randomness test battery for strings that no pattern names.

Candidates of the battery are runs of token characters that mix at least two kinds (lower, upper, digit).  Their encoding is
inferred (hex, base32, base36, base62, base64, base64url or, for runs that mix the signs of both, all of them); three tests ask whether the
characters could be uniform draws from it: chi-squared over the alphabet, Wald-Wolfowitz runs above and below the alphabet's middle, and
serial correlation.  Fisher's method combines their p-values; a run that is rejected is text, not a key.  Short runs pass such tests
easily, so a run must also earn evidence: the likelihood ratio of uniform draws against ordinary text (letter frequencies), an e-value whose
logarithm grows with length.  Runs of fewer than ``SHORTEST`` characters aren't candidates: the three tests have too little power on them to tell a
key from a name with a digit in it.

The e-Benjamini-Hochberg rule controls the false-discovery rate at ``FDR`` over all candidates of the table: candidates are counted by their
evidence in steps of ``STEP`` (rounded down), a histogram of a bounded size, and the k that have the most are discoveries where the k-th
e-value is m / (k * FDR) or more.  ``scan`` does the same over the candidates of one text.

Defined results: a null or empty text has no spans; rows are scanned one by one, whole, so ties, repeated rows, null ids
and extra columns change nothing; spans of other kinds keep candidates that overlap them from being tested; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, map_arrow, strings

#: Kinds in the order in which they are listed.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # what is left of the matches of [0-9a-f]+ when the short ones are dropped
KINDS = ("assign", "access", "hex", "random")
FDR, UNIFORM_P = 0.01, 0.001
#: Characters of a candidate at least, steps of evidence, and where its histogram ends.
SHORTEST, STEP, MOST = 16, 0.1, 100.0
_SPANS = "array<struct<start:int,kind:int,end:int>>"
_CANDIDATES = "array<struct<start:int,end:int,evidence:double>>"
_SCHEMA = f"doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base {_SPANS}, candidates {_CANDIDATES}"

_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_-]{{{SHORTEST},}}={{0,2}}")
_ALPHABETS = [(re.compile(p), "".join(map(chr, codes))) for p, codes in (
    (r"[0-9a-f]+\Z", [*range(48, 58), *range(97, 103)]),
    (r"[0-9A-F]+\Z", [*range(48, 58), *range(65, 71)]),
    (r"[A-Z2-7]+\Z", [*range(65, 91), *range(50, 56)]),
    (r"[0-9a-z]+\Z", [*range(48, 58), *range(97, 123)]),
    (r"[0-9A-Z]+\Z", [*range(48, 58), *range(65, 91)]),
    (r"[A-Za-z0-9]+\Z", [*range(65, 91), *range(97, 123), *range(48, 58)]),
    (r"[A-Za-z0-9+/]+\Z", [*range(65, 91), *range(97, 123), *range(48, 58), 43, 47]),
    (r"[A-Za-z0-9_-]+\Z", [*range(65, 91), *range(97, 123), *range(48, 58), 45, 95]),
    (r"[A-Za-z0-9+/_-]+\Z", [*range(65, 91), *range(97, 123), *range(48, 58), 43, 47, 45, 95]),
)]
#: Rough frequencies of letters in ordinary European text, per thousand, a to z.
_LETTERS = [80, 15, 30, 40, 120, 20, 20, 40, 75, 3, 7, 42, 26, 72, 70, 22, 2, 65, 68, 80, 32, 12, 14, 2, 12, 3]


def _ordinary() -> dict[str, float]:
    """log-probability of a character of ordinary token text, after a character of the same kind."""
    p = {chr(97 + k): 0.80 * f / sum(_LETTERS) for k, f in enumerate(_LETTERS)}
    p |= {chr(65 + k): 0.08 * f / sum(_LETTERS) for k, f in enumerate(_LETTERS)}
    p |= {str(d): 0.006 for d in range(10)}
    p |= {c: 0.015 for c in "+/_-"}
    return {c: math.log(x) for c, x in p.items()}


_TEXT = _ordinary()


def _log_erfc_tail(z: float) -> float:
    """Two-sided normal p-value."""
    return max(1e-300, math.erfc(abs(z) / math.sqrt(2)))


def _chi2_tail(x: float, k: int) -> float:
    """Upper tail of chi-squared by the Wilson-Hilferty normal approximation."""
    if x <= 0:
        return 1.0
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return max(1e-300, 0.5 * math.erfc(z / math.sqrt(2)))


def infer_alphabet(token: str) -> str | None:
    for pattern, letters in _ALPHABETS:
        if pattern.match(token):
            return letters
    return None


def uniformity(token: str, letters: str) -> float:
    """Fisher's combined p-value of the three tests."""
    x = np.array([letters.index(c) for c in token], float)
    n, k = len(x), len(letters)
    bins = min(k, max(2, n // 5))  # so that five are expected in each
    counts = np.bincount((x * bins / k).astype(int), minlength=bins)
    expected = np.bincount((np.arange(k) * bins / k).astype(int), minlength=bins) * n / k
    chi = _chi2_tail(float(((counts - expected) ** 2 / expected).sum()), bins - 1)
    high = x >= k / 2
    n1 = int(high.sum())
    n2 = n - n1
    if n1 and n2:
        runs, mean = 1 + int((high[1:] != high[:-1]).sum()), 1 + 2 * n1 * n2 / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        run_p = _log_erfc_tail((runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        run_p = max(1e-300, 2.0 ** (1 - n))
    y = x - x.mean()
    var = float((y * y).sum())
    serial = _log_erfc_tail(float((y[1:] * y[:-1]).sum()) / var * math.sqrt(n)) if var > 0 else 1e-300
    return _chi2_tail(-2 * (math.log(chi) + math.log(run_p) + math.log(serial)), 6)


def evidence(token: str, letters: str) -> float:
    """Log of the likelihood ratio of uniform draws against ordinary text."""
    return -len(token) * math.log(len(letters)) - sum(_TEXT[c] for c in token)


def candidates(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int, float]]:
    """(start, end, evidence) of runs that overlap none of the sorted spans ``taken``; those that the tests reject have no evidence."""
    found, k, reach = [], 0, 0
    for m in _CANDIDATE.finditer(text):
        while k < len(taken) and taken[k][0] < m.end():  # both are in order, so one pass over either will do
            reach = max(reach, taken[k][1])
            k += 1
        token = m[0].rstrip("=")
        kinds = any(c.islower() for c in token) + any(c.isupper() for c in token) + any(c.isdigit() for c in token)
        if kinds < 2 or reach > m.start():
            continue
        letters = infer_alphabet(token)
        e = evidence(token, letters) if letters else -math.inf
        found.append((m.start(), m.end(), e if e > 0 and uniformity(token, letters) > UNIFORM_P else -math.inf))
    return found


def _step(evidence: float) -> int:
    """The place in the histogram; what has no evidence is at -1."""
    return -1 if evidence <= 0 else int(min(evidence, MOST) / STEP)


def threshold(counts: dict[int, int], fdr: float = FDR) -> float:
    """The least evidence of a discovery, for numbers of candidates by step: infinite where nothing is found."""
    m, k, least = sum(counts.values()), 0, math.inf
    for step in sorted(counts, reverse=True):
        k += counts[step]
        if step >= 0 and step * STEP >= math.log(m / (k * fdr)):
            least = step * STEP
    return least


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end), sorted; offsets are code points, ends exclusive."""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(base)


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of one text."""
    base, counts = base_spans(text), {}
    more = candidates(text, [(a, b) for a, _, b in base])
    for _, _, e in more:
        counts[_step(e)] = counts.get(_step(e), 0) + 1
    least = threshold(counts)
    return base, sorted([*base, *((a, 3, b) for a, b, e in more if _step(e) * STEP >= least)])


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_documents(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random: a row per row."""

    def f(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), strings(b.column(1)), strict=True):
                base = base_spans(text)
                n = [sum(k == x for _, x, _ in base) for k in range(3)]
                spans = [{"start": a, "kind": k, "end": z} for a, k, z in base]
                more = [{"start": a, "end": z, "evidence": e} for a, z, e in candidates(text, [(a, z) for a, _, z in base])]
                out.append((doc, *n, hashlib.sha256(written(base).encode()).hexdigest(), spans, more))
            whole = pa.int32()
            kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct({"start": whole, "kind": whole, "end": whole})), pa.list_(pa.struct({"start": whole, "end": whole, "evidence": pa.float64()}))]
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "candidates"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], names)

    scanned = cut(map_arrow(documents.select(F.col("doc_id").cast("long"), "text"), f, _SCHEMA))
    step = lambda e: F.when(e <= 0, -1).otherwise(F.floor(F.least(e, F.lit(MOST)) / STEP)).cast("int")
    each = scanned.select(F.explode("candidates").alias("c")).groupBy(step(F.col("c.evidence")).alias("step")).count()
    least = threshold({r["step"]: r["count"] for r in each.collect()})  # a row for each step at most
    random = F.filter("candidates", lambda c: step(c["evidence"]) * STEP >= least) if least < math.inf else F.filter("candidates", lambda c: F.lit(False))
    found = F.transform(random, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    names = F.array(*map(F.lit, KINDS))
    spans = F.transform(F.array_sort(F.concat("base", found)), lambda x: F.concat_ws(":", names[x["kind"]], x["start"], x["end"]))
    return scanned.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(spans, ",").alias("spans"), F.size(found).cast("long").alias("n_random"))
