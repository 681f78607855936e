"""Quality rules by weak supervision.

Each rule looks at one surface statistic of the whole text and votes good (1),
bad (-1) or abstains (0).  Nobody knows how good a rule is: expectation
maximisation estimates, for good texts and for each kind of junk, how often each
rule is right when it votes, from how the rules agree over all documents.  A document is kept when
the posterior probability of the good class is at least ``threshold``, not
when it passes every rule.

Defined results
---------------
null or empty text: no words, every rule abstains, the posterior is the prior;
rows that repeat an id are scored row by row; an empty table gives no rows;
further columns of the input are ignored, so their names can't clash.

Scale: one pass over the text makes a narrow table of statistics (written to
the shared folder).  EM needs only the number of documents for each vote
pattern: at most 3**len(RULES) rows however large the corpus, so that table is
what goes to the driver, and the posterior of each pattern is what comes back.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import texts_of
from .shared import write_table
from .words import chunks, mix, split_words, whole, window_names

SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_LETTERS = _UPPER + _LOWER + bytes(range(0xC3, 0x100))  # and the first byte of any code point from U+00C0 on
_FOLLOWING = bytes(range(0x80, 0xC0))  # UTF-8 bytes that continue a code point
_ENDS = (b".", b"!", b"?", b":", b'"', b"'", b")", "…".encode(), "”".encode(), "»".encode())

STATISTICS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_ended_lines", "n_upper", "n_lower", "n_exclaim", "n_distinct", "n_letters",
)


def _lines(text: bytes) -> tuple[int, int, int]:
    """Lines with a word, those equal to an earlier one, those that end a sentence."""
    kept = [x for x in text.split(b"\n") if x.strip(_SPACE)]
    ended = sum(x.rstrip(_SPACE).endswith(_ENDS) for x in kept)
    return len(kept), len(kept) - len(set(kept)), ended


def _repeats(names: np.ndarray, offsets: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each document, words in 3-word windows found twice or more in it, and distinct words."""
    n_docs = len(offsets) - 1
    salt = mix(np.arange(1, n_docs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    distinct = np.zeros(n_docs, dtype=np.int64)
    own = np.unique(names ^ salt[docs], return_index=True)[1] if len(names) else np.empty(0, dtype=np.int64)
    np.add.at(distinct, docs[own], 1)
    covered = np.zeros(len(names) + 1, dtype=np.int32)
    at = whole(offsets, 3)
    if len(at):
        tri = window_names(names, 3)[at] ^ salt[docs[at]]
        order = np.argsort(tri, kind="stable")
        same = tri[order][1:] == tri[order][:-1]
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:]] = same
        twice[order[:-1]] |= same
        hit = at[twice]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + 3, -1) if len(hit) else None
    repeated = np.cumsum(covered)[:-1] > 0
    return np.bincount(docs[repeated], minlength=n_docs), distinct


def statistics_of(texts: list[bytes]) -> dict[str, np.ndarray]:
    out: dict[str, list] = {k: [] for k in STATISTICS}
    for a, b in chunks([len(t) for t in texts]):
        part = texts[a:b]
        w = split_words(part)
        repeat, distinct = _repeats(w.names, w.offsets, w.docs())
        lines = [_lines(t) for t in part]
        out["n_words"] += w.counts.tolist()
        out["word_chars"] += [len(t.translate(None, _SPACE + _FOLLOWING)) for t in part]
        out["n_symbols"] += [len(t) - len(t.translate(None, SYMBOLS)) for t in part]
        out["n_dup_lines"] += [x[1] for x in lines]
        out["n_repeat_words"] += repeat.tolist()
        out["n_lines"] += [x[0] for x in lines]
        out["n_ended_lines"] += [x[2] for x in lines]
        out["n_upper"] += [len(t) - len(t.translate(None, _UPPER)) for t in part]
        out["n_lower"] += [len(t) - len(t.translate(None, _LOWER)) for t in part]
        out["n_exclaim"] += [t.count(b"!") for t in part]
        out["n_distinct"] += distinct.tolist()
        out["n_letters"] += [len(t) - len(t.translate(None, _LETTERS)) for t in part]
    return {k: np.asarray(v, dtype=np.int64) for k, v in out.items()}


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, else good where ``good`` holds, else abstains."""

    name: str
    good: str
    bad: str

    def vote(self) -> Column:
        return F.expr(f"CASE WHEN n_words = 0 THEN 0 WHEN {self.bad} THEN -1 WHEN {self.good} THEN 1 ELSE 0 END")


RULES = (
    Rule("symbols", good="50 * n_symbols <= n_words", bad="5 * n_symbols >= n_words"),
    Rule("capitals", good="5 * n_upper <= n_upper + n_lower AND n_lower > 0", bad="2 * n_upper > n_upper + n_lower AND n_upper >= 20"),
    Rule("exclaims", good="100 * n_exclaim <= n_words", bad="6 * n_exclaim >= n_words AND n_exclaim >= 5"),
    Rule("repeats", good="20 * n_repeat_words <= n_words", bad="3 * n_repeat_words >= n_words"),
    Rule("lines", good="n_dup_lines = 0", bad="3 * n_dup_lines >= n_lines AND n_dup_lines >= 2"),
    Rule("endings", good="2 * n_ended_lines >= n_lines", bad="10 * n_ended_lines < n_lines AND n_lines >= 3"),
    Rule("word_length", good="word_chars BETWEEN 3 * n_words AND 9 * n_words", bad="word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule("letters", good="25 * n_letters >= 23 * word_chars", bad="5 * n_letters < 4 * word_chars AND word_chars >= 20"),
    Rule("variety", good="5 * n_distinct >= 2 * n_words OR n_distinct >= 300", bad="8 * n_distinct < n_words AND n_distinct < 300"),
)


#: Junk comes in kinds: rules that look at one side of a text tend to fail together, and as evidence they count together.
KINDS = (("symbols", "letters"), ("capitals", "exclaims"), ("repeats", "lines", "variety"))
#: Where EM starts: how often a rule that votes is right of a good text, of junk of its own kind and of another one; the share of good texts.
START_GOOD, START_OWN, START_OTHER, START_PRIOR = 0.98, 0.7, 0.1, 0.8


def start_of(names: Sequence[str], kinds: Sequence[Sequence[str]] = KINDS) -> np.ndarray:
    """Where EM starts: accuracies [kind, rule] of rules of junk."""
    return np.array([[START_OWN if n in kind else START_OTHER for n in names] for kind in kinds])


def fit_em(patterns: np.ndarray, counts: np.ndarray, start: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Shares [class] and rule accuracies [class, rule] from vote patterns; class 0 is good, the others are kinds of junk.

    ``right[0, j]`` is how often rule j says good of a good document when it
    votes, ``right[k, j]`` how often it says bad of junk of kind k.  All start at
    fixed values and carry them as pseudo-counts (a few thousandths of the
    corpus), which keeps classes what they are called and keeps a rule that
    never votes where it started.
    """
    start = np.vstack([np.full(start.shape[1], START_GOOD), start])
    first = np.concatenate(([START_PRIOR], np.full(len(start) - 1, (1 - START_PRIOR) / (len(start) - 1))))
    prior, right = first, start
    total = counts.sum()
    if not total:
        return prior, right
    weight = max(10.0, 0.002 * total)
    for _ in range(rounds):
        share = memberships(patterns, prior, right) * counts[:, None]
        was = right
        votes = share.T @ (patterns != 0)
        hits = np.vstack([share[:, :1].T @ (patterns == 1), share[:, 1:].T @ (patterns == -1)])
        right = (hits + start * weight) / (votes + weight)
        prior = (share.sum(axis=0) + first * weight) / (total + weight)
        if np.abs(right - was).max() < 1e-9:
            break
    return prior, right


def memberships(patterns: np.ndarray, prior: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Probabilities [pattern, class]."""
    says_good = np.vstack([right[:1], 1 - right[1:]])
    log = np.log(prior) + (patterns == 1) @ np.log(says_good).T + (patterns == -1) @ np.log(1 - says_good).T
    odds = np.exp(log - log.max(axis=1, keepdims=True, initial=-np.inf)) if len(log) else log
    return odds / odds.sum(axis=1, keepdims=True)


def posterior(patterns: np.ndarray, prior: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Probability of the good class."""
    return memberships(patterns, prior, right)[:, 0]


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: id, the statistics, ``quality_probability`` and ``kept_by_votes``."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = statistics_of(texts_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[k]) for k in STATISTICS)], names=["id", *STATISTICS])

    schema = f"id {id_type}, " + ", ".join(f"{k} bigint" for k in STATISTICS)
    measured = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(measure, schema)
    code = sum(((r.vote() + 1) * (3**i) for i, r in enumerate(RULES)), F.lit(0))
    stats = write_table(measured.withColumn("pattern", code.cast("int")), "rule-votes")

    seen = stats.groupBy("pattern").count().collect()  # at most 3 ** len(RULES) rows
    codes = np.array([r[0] for r in seen], dtype=np.int64)
    counts = np.array([r[1] for r in seen], dtype=np.float64)
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order]
    patterns = np.stack([codes // 3**i % 3 - 1 for i in range(len(RULES))], axis=1) if len(codes) else np.empty((0, len(RULES)))
    prior, right = fit_em(patterns, counts, start_of([r.name for r in RULES]))
    good = posterior(patterns, prior, right)
    table = docs.sparkSession.createDataFrame([(int(c), float(round(p, 9))) for c, p in zip(codes, good, strict=True)], "pattern int, quality_probability double")
    return (
        stats.join(F.broadcast(table), "pattern")
        .withColumn("kept_by_votes", F.col("quality_probability") >= threshold)
        .select(F.col("id").alias(id_col), *STATISTICS, "quality_probability", "kept_by_votes")
    )
