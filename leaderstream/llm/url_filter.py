"""URL filter: rules of hosts and paths first, then words of host and path by naive Bayes.

1. Names in a host (runs of letters) are split into words by unigram Viterbi: of all ways to cut a name, the one whose
   words are likeliest together. Words and counts come from all pages (``lexicon``). Every part of every distinct name meets
   the lexicon in a join, so neither is held by one task, and a task then cuts one name at a time.
2. URLs that differ in digits only are one cell. A cell whose words hold one of ``SEEDS`` is an example of what to block,
   any other of what to allow, and counts as often as its URLs occur. Words of host and path make one multinomial model of each kind.
3. A URL is blocked where the log likelihoods of its words and the ``PRIOR`` say so. Evidence is kept in millionths, so sums
   don't depend on their order.

A URL that a rule fits has the rule's verdict.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import log
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import free_names, kept

ALLOW, BLOCK = "allow", "block"
#: Letters of a word of the lexicon, at least and at most; other stretches of a name are words that the lexicon lacks.
SHORTEST, LONGEST = 2, 24
#: No label of a host name is longer; a longer run of letters is no name and stays whole.
LONGEST_NAME = 63
#: A word that the lexicon lacks is as likely as one that occurs once, by a factor of one in so many for each letter.
LETTERS = 30
#: Share of URLs that are to be blocked before anything is known of them.
PRIOR = 0.1
#: Added to every count of a word.
SMOOTHING = 0.5
#: Words that mark examples of what to block.
SEEDS = (
    "adult", "ads", "bet", "bets", "betting", "casino", "escort", "gambling", "jackpot", "malware", "nude", "phishing",
    "pills", "poker", "porn", "sex", "slots", "spam", "viagra", "warez", "xxx",
)

_UNIT = 1e6
_A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Rule(NamedTuple):
    """``host`` and all its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; from there to ``?``, ``#`` or the end.

    Both are empty for NULL and where there is no ``://``.
    """
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, _A_TO_Z, _A_TO_Z.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def ruled(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; NULL without one.

    Of two that are equally long the one with the longer host, of two alike the one that blocks. Rules are part of the plan.
    """
    rule = verdict = F.lit(None).cast("string")
    # The last one put around is asked first.
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), len(r.host), r.verdict)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule = F.when(fits, F.lit(r.host + r.path)).otherwise(rule)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\p{L}+)"), F.lit(1))


def _tokens(shape: Column) -> Column:
    """Words of a path, and runs of digits by their length."""
    return F.regexp_extract_all(shape, F.lit(r"(\p{L}+|0+)"), F.lit(1))


def _shape(path: Column) -> Column:
    """A path in lower case, all digits alike."""
    return F.regexp_replace(F.lower(path), "[0-9]", "0")


def _cells(pages: DataFrame, url: str) -> DataFrame:
    host, path = host_and_path(F.col(url))
    cells = pages.select(host.alias("host"), _shape(path).alias("shape")).groupBy("host", "shape")
    return cells.agg(F.count(F.lit(1)).alias("n"))


def lexicon(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``word`` and ``n``: the words of all pages outside tags, of their paths, and between the hyphens of their hosts;
    ``SEEDS`` once more each. Hosts and paths count once for each URL that differs in more than digits.

    Names as such are no evidence for words: they may be several.
    """
    text = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"<[^<>]*>|&#?\w{1,9};", " ")
    cells = _cells(pages, url)
    hyphened = F.filter(F.split("host", r"\."), lambda label: label.contains("-"))
    sources = [
        pages.select(F.explode(_runs(F.lower(text))).alias("word")),
        cells.select(F.explode(F.concat(_runs("shape"), _runs(F.array_join(hyphened, ".")))).alias("word")),
        pages.sparkSession.createDataFrame([(s,) for s in SEEDS], "word string"),
    ]
    words = sources[0].unionByName(sources[1]).unionByName(sources[2])
    fits = F.length("word").between(SHORTEST, LONGEST)
    return kept(words.where(fits).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "url-lexicon")


def best_words(name: str, found: list[tuple[int, int, int]], total: int) -> list[str]:
    """The likeliest words of a name by the counts of its parts ``(begin, length, n)``; of equally likely ways
    the one whose last word is the longest, and so on to the front."""
    costs = {(begin, begin + length): log(total / n) for begin, length, n in found}
    least, came = [0.0], [0]
    for end in range(1, len(name) + 1):
        best, at = float("inf"), 0
        for begin in range(end):
            unknown = log(total) + (end - begin) * log(LETTERS)
            cost = least[begin] + costs.get((begin, end), unknown)
            if cost < best - 1e-9:
                best, at = cost, begin
        least.append(best)
        came.append(at)
    words, end = [], len(name)
    while end:
        words.append(name[came[end] : end])
        end = came[end]
    return words[::-1]


def _cut(total: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, parts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            words = [
                best_words(name, [(p["at"] - 1, p["length"], p["n"]) for p in found or []], total)
                if len(name) <= LONGEST_NAME
                else [name]
                for name, found in zip(names, parts, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], ["name", "words"])

    return cut


def segmented(names: DataFrame, words: DataFrame) -> DataFrame:
    """``name`` and its ``words`` for each distinct ``name``; ``words`` of a ``lexicon``."""
    total = words.agg(F.coalesce(F.sum("n"), F.lit(1))).first()[0]
    names = names.distinct()
    length = F.length("name")
    starts = names.where(length.between(SHORTEST, LONGEST_NAME)).select(
        "name", F.explode(F.sequence(F.lit(1), length - SHORTEST + 1)).alias("at")
    )
    lengths = F.sequence(F.lit(SHORTEST), F.least(F.lit(LONGEST), length - F.col("at") + 1))
    parts = starts.select("name", "at", F.explode(lengths).alias("length"))
    parts = parts.select("name", "at", "length", F.expr("substr(name, at, length)").alias("word"))
    # A name has at most LONGEST_NAME times LONGEST parts.
    known = parts.join(words, "word").groupBy("name").agg(F.collect_list(F.struct("at", "length", "n")).alias("found"))
    return names.join(known, "name", "left").mapInArrow(_cut(total), "name string, words array<string>")


class Features(NamedTuple):
    """``cells``: ``host, shape, n, seeded``; ``hosts``: ``host, token, k``, how often a word is in the host."""

    cells: DataFrame
    hosts: DataFrame


def features(pages: DataFrame, words: DataFrame, url: str = "url") -> Features:
    cells = kept(_cells(pages, url), "url-cells")
    runs = cells.select("host").distinct().select("host", F.explode(_runs("host")).alias("name"))
    cut = kept(segmented(runs.select("name"), words), "url-names")
    hosts = runs.join(cut, "name").select("host", F.explode("words").alias("token"))
    hosts = kept(hosts.groupBy("host", "token").agg(F.count(F.lit(1)).alias("k")), "url-hosts")
    seeded = hosts.where(F.col("token").isin(*SEEDS)).select("host").distinct().withColumn("_seeded", F.lit(True))
    in_path = F.arrays_overlap(_tokens("shape"), F.array(*[F.lit(s) for s in SEEDS]))
    marked = cells.join(seeded, "host", "left").withColumn("seeded", F.coalesce("_seeded", F.lit(False)) | in_path)
    return Features(kept(marked.drop("_seeded"), "url-marked"), hosts)


def learn(found: Features) -> DataFrame:
    """``token`` and its ``evidence`` for blocking, in millionths of a natural logarithm.

    A word's counts are of URLs, repeats within one included. Words that no URL has are not in the table: they say
    nothing. Without examples of one kind the smoothing alone speaks for it.
    """
    of_hosts = found.cells.groupBy("host", "seeded").agg(F.sum("n").alias("n")).join(found.hosts, "host")
    of_paths = found.cells.groupBy("shape", "seeded").agg(F.sum("n").alias("n"))
    tokens = of_hosts.select("token", "seeded", (F.col("n") * F.col("k")).alias("n")).unionByName(
        of_paths.select(F.explode(_tokens("shape")).alias("token"), "seeded", "n")
    )
    kind = lambda seeded: F.sum(F.when(F.col("seeded") == seeded, F.col("n")).otherwise(0))
    counts = kept(tokens.groupBy("token").agg(kind(True).alias("bad"), kind(False).alias("good")), "url-counts")
    bad, good, size = counts.agg(
        F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0)), F.count(F.lit(1))
    ).first()
    share = lambda n, total: F.log((F.col(n) + SMOOTHING) / F.lit(total + SMOOTHING * max(size, 1)))
    evidence = F.round((share("bad", bad) - share("good", good)) * _UNIT).cast("bigint")
    return kept(counts.select("token", evidence.alias("evidence")), "url-evidence")


def _scores(found: Features, evidence: DataFrame) -> DataFrame:
    """``host, shape, score`` for each cell: log odds of blocking in millionths."""
    prior = round(log(PRIOR / (1 - PRIOR)) * _UNIT)
    hosts = found.hosts.join(evidence, "token").groupBy("host").agg(F.sum(F.col("k") * F.col("evidence")).alias("_h"))
    shapes = found.cells.select("shape").distinct().select("shape", F.explode(_tokens("shape")).alias("token"))
    shapes = shapes.join(evidence, "token").groupBy("shape").agg(F.sum("evidence").alias("_p"))
    zero = F.lit(0)
    total = F.lit(prior) + F.coalesce("_h", zero) + F.coalesce("_p", zero)
    cells = found.cells.join(hosts, "host", "left").join(shapes, "shape", "left")
    return kept(cells.select("host", "shape", total.alias("score")), "url-scores")


def judged(
    pages: DataFrame,
    evidence: DataFrame,
    found: Features,
    rules: Sequence[Rule] = (),
    url: str = "url",
) -> DataFrame:
    """All rows and columns of ``pages``, and ``host``, ``path``, ``rule``, ``score`` and ``verdict``.

    ``found`` are the features of these pages, ``evidence`` what ``learn`` made of these or other ones. ``score``
    is the method's log odds of blocking in millionths, whatever the rules say; ``verdict`` is the rule's, or blocks where
    the score is above 0. A URL that is NULL, empty or without ``://`` has an empty host and path, which no rule with a
    path fits and no word speaks about. Rows and ids may repeat or be NULL; columns of ``pages`` with the new names are
    replaced. An empty table gives an empty result.
    """
    pages = pages.drop(*[c for c in ("host", "path", "rule", "score", "verdict") if c != url])
    shape, c_host, c_shape, decided = free_names(pages, ["_shape", "_c_host", "_c_shape", "_decided"])
    host, path = host_and_path(F.col(url))
    rule, verdict = ruled(rules, F.col("host"), F.col("path"))
    rows = pages.withColumns({"host": host, "path": path})
    rows = rows.withColumns({"rule": rule, decided: verdict, shape: _shape(F.col("path"))})
    scores = _scores(found, evidence).withColumnsRenamed({"host": c_host, "shape": c_shape})
    rows = rows.join(scores, (F.col("host") == F.col(c_host)) & (F.col(shape) == F.col(c_shape)))
    method = F.when(F.col("score") > 0, BLOCK).otherwise(ALLOW)
    return rows.withColumn("verdict", F.coalesce(decided, method)).drop(shape, c_host, c_shape, decided)
