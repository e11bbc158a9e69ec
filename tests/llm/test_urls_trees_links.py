"""URL filter, Merkle manifest and token alignment against brute force, and on odd rows."""

import hashlib
import itertools
import re
import zlib
from collections import Counter
from math import log

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest import SF_DIR
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leaderstream.llm import alignment, merkle, url_filter
from leaderstream.llm.queries import BYTE_BPE, PIECE_BPE, QUERIES, URL_RULES
from leaderstream.llm.tables import table

A, B = public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE)


# URLs


def split_url(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return lower, re.match(r"[^?#]*", rest[len(host) :])[0]


def every_cut(name):
    for n in range(len(name)):
        for cuts in itertools.combinations(range(1, len(name)), n):
            ends = [0, *cuts, len(name)]
            yield [name[a:b] for a, b in itertools.pairwise(ends)]


def cost(words, counts, total):
    return sum(log(total / counts[w]) if w in counts else log(total) + len(w) * log(url_filter.LETTERS) for w in words)


def judge(pages):
    """Verdicts and rules of ``(page_id, url, html)``, all in plain Python."""
    counts, cells = Counter(), Counter()
    runs = lambda text: re.findall(r"[^\W\d_]+", text)
    places = {}
    for page, url, html in pages:
        host, path = split_url(url)
        places[page] = (host, path)
        cells[host, re.sub("[0-9]", "0", path.lower())] += 1
        counts.update(runs(re.sub(r"<[^<>]*>|&#?\w{1,9};", " ", html or "").lower()))
    for host, shape in cells:
        counts.update(runs(shape) + [w for label in host.split(".") if "-" in label for w in runs(label)])
    counts.update(url_filter.SEEDS)
    counts = {w: n for w, n in counts.items() if 2 <= len(w) <= url_filter.LONGEST}
    total = sum(counts.values())

    def segmented(name):
        if len(name) > url_filter.LONGEST_NAME:
            return [name]
        found = [(i, j - i, counts[name[i:j]]) for i in range(len(name)) for j in range(i + 2, len(name) + 1) if name[i:j] in counts]
        return url_filter.best_words(name, found, total)

    words = {h: Counter(w for name in runs(h) for w in segmented(name)) for h, _ in cells}
    tokens = {s: re.findall(r"[^\W\d_]+|0+", s) for _, s in cells}
    bad, good = Counter(), Counter()
    for (h, s), n in cells.items():
        seeded = any(w in url_filter.SEEDS for w in [*words[h], *tokens[s]])
        for w, k in (words[h] + Counter(tokens[s])).items():
            (bad if seeded else good)[w] += n * k
    size, a, b = len({*bad, *good}), sum(bad.values()), sum(good.values())
    smooth = url_filter.SMOOTHING
    share = lambda n, t: log((n + smooth) / (t + smooth * size))
    evidence = {w: round((share(bad[w], a) - share(good[w], b)) * 1e6) for w in {*bad, *good}}
    out = {}
    for page, (host, path) in places.items():
        fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.host + r.path), default=None)
        shape = re.sub("[0-9]", "0", path.lower())
        score = log(0.1 / 0.9) * 1e6 + sum(evidence[w] * k for w, k in words[host].items()) + sum(evidence[w] for w in tokens[shape])
        verdict = rule.verdict if rule else "block" if score > 0 else "allow"
        out[page] = (host, path, rule and rule.host + rule.path, verdict)
    return out


def test_urls_of_all_pages(spark):
    folder = "/root/testdata/sf0.01"
    rows = table(spark, folder, "pages").collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in QUERIES["op11_url_filter"](spark, folder).collect()}
    assert got == judge([(r.page_id, r.url, r.html) for r in rows])
    assert {v[3] for v in got.values() if v[2] is None} == {"allow", "block"}


@pytest.mark.parametrize("name", ["freebets", "thecat", "xqzt", "aa", "catthe", "the"])
def test_the_likeliest_words(name):
    counts = {"free": 3, "bets": 2, "the": 90, "cat": 9, "he": 20, "at": 30, "be": 8}
    total = sum(counts.values())
    found = [(i, j - i, counts[name[i:j]]) for i in range(len(name)) for j in range(i + 1, len(name) + 1) if name[i:j] in counts]
    best = url_filter.best_words(name, found, total)
    assert "".join(best) == name
    assert cost(best, counts, total) == pytest.approx(min(cost(w, counts, total) for w in every_cut(name)))


URLS = [
    None, "", "no scheme", "http://", "http://A.Example.COM", "https://www.example.com/en/1", "ftp://example.com/en/x?y#z",
    "http://badexample.com/en/", "x://y.net/es/#", "http://net/fr/1", "http://a.net/de/://b", "http://h?://x/en/", "http://ex.org#f/en/",
    "http://FREECASINO.org/Play/12", "http://" + "x" * 200 + ".org/", "http://ab\ncd.org/p\nq?", "http://example.com/EN/1", "http://a.com.org/",
]


def test_odd_urls(spark):
    rows = [(n if n % 5 else None, u, "casino<b>free</b>", n, "own") for n, u in enumerate(URLS)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, score int, _shape string")
    words = url_filter.lexicon(pages)
    found = url_filter.features(pages, words)
    judged = url_filter.judged(pages, url_filter.learn(found), found, URL_RULES).collect()
    assert len(judged) == len(URLS) and {r["_shape"] for r in judged} == {"own"}
    wanted = judge([(n, u, "casino<b>free</b>") for n, u in enumerate(URLS)])
    assert Counter((r.host, r.path, r.rule, r.verdict) for r in judged) == Counter(wanted.values())
    assert next(r for r in judged if r.url and "FREECASINO" in r.url).verdict == "block"
    none = pages.limit(0)
    found = url_filter.features(none, url_filter.lexicon(none))
    assert url_filter.judged(none, url_filter.learn(found), found, URL_RULES).collect() == []


def test_equal_rules_and_their_order(spark):
    rules = [url_filter.Rule("allow", "a.b", "/"), url_filter.Rule("block", "b", "/xy"), url_filter.Rule("block", "a.b", "/")]
    frame = spark.createDataFrame([("x.a.b", "/xyz"), ("a.b", "/"), ("b", "/x"), ("ab", "/")], "host string, path string")
    rule, verdict = url_filter.ruled(rules, F.col("host"), F.col("path"))
    got = [tuple(r) for r in frame.select(rule.alias("r"), verdict.alias("v")).collect()]
    assert got == [("a.b/", "block"), ("a.b/", "block"), (None, None), (None, None)]


# Trees


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
    return levels


def others(levels, at):
    for nodes in levels[:-1]:
        run = nodes[at - at % 8 : at - at % 8 + 8]
        yield at % 8, run[: at % 8] + run[at % 8 + 1 :]
        at //= 8


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 100, 513])
def test_places_in_the_log(n):
    order = []

    def complete(level, index):
        if level:
            for child in range(8 * index, min(8 * index + 8, -(-n // 8 ** (level - 1)))):
                complete(level - 1, child)
        order.append((level, index))

    complete(merkle.height(n), 0)
    assert [int(merkle.positions(level, np.array([index]), n)[0]) for level, index in order] == list(range(len(order)))


def manifest_of(rows):
    """By doc_id, which is unique here: what ``merkle.manifest`` should say of ``(doc_id, source, lang, n_chars, text)``."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: h(*[field(v) for v in r])
    by = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree_of([leaf(r) for r in by[x]]) for x in langs}
    top = tree_of([trees[x][-1][0] for x in langs])
    out = {}
    for k, x in enumerate(langs):
        for at, r in enumerate(by[x]):
            path = [*others(trees[x], at), *others(top, k)]
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4] or "")
            folded = leaf((*r[:4], lower)) if changed else trees[x][0][at]
            for place, rest in path:
                folded = h(*rest[:place], folded, *rest[place:])
            proof = h(*[d for _, rest in path for d in rest])
            out[r[0]] = (trees[x][0][at], trees[x][-1][0], top[-1][0], proof, folded, folded == top[-1][0])
    return out


def odd_documents(n):
    langs = ["en", "de", None, "é", "", "zz"]
    texts = ["Ä Big Text", None, "", "lower", "A" * 5000, "ÀÉ only these are large"]
    return [(k, None if k % 7 == 0 else f"s{k % 3}", langs[min(k % 11, 5) if k < 40 else 0], k if k % 5 else None, texts[k % 6]) for k in range(n)]


DOCS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("levels", [1, 4])
@pytest.mark.parametrize("n", [1, 9, 150])
def test_manifest_of_odd_documents(spark, n, levels):
    rows = odd_documents(n)
    frame = spark.createDataFrame(rows, DOCS).withColumns({"tree": F.lit(1), "index": F.lit("x"), "n": F.lit(None).cast("int")})
    got = {r[0]: tuple(r[1:]) for r in merkle.manifest(frame, levels=levels).collect()}
    assert got == manifest_of(rows)
    if n == 150:
        assert {v[-1] for v in got.values()} == {True, False}


def test_manifest_of_repeated_null_and_no_rows(spark):
    frame = spark.createDataFrame([(None, "s", "en", 1, "x"), (3, "s", "en", 1, "Y")] * 3 + [(3, "s", "en", 1, "other")], DOCS)
    first = Counter(tuple(r) for r in merkle.manifest(frame).collect())
    second = Counter(tuple(r) for r in merkle.manifest(frame.repartition(3)).collect())
    assert first == second and sum(first.values()) == 7
    assert {r[3] for r in first} == {next(iter(first))[3]}
    assert merkle.manifest(frame.limit(0)).collect() == []


# Tokens of two kinds


def token_bytes():
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    letters = {chr(b): b for b in prints} | {chr(256 + n): b for n, b in enumerate(rest)}
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True

    def encoded(text):
        if not text:
            return [], [], [], []
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(letters[c] for c in a.id_to_token(k)) for k in ids_a]
        pieces = [(b.id_to_piece(k), b.is_byte(k)) for k in ids_b]
        bytes_b = [bytes([int(p[3:5], 16)]) if one else p.replace("\u2581", " ").encode() for p, one in pieces]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            return [], [], [], []
        return ids_a, bytes_a, ids_b, bytes_b

    return encoded


@pytest.fixture(scope="module")
def encoded():
    return token_bytes()


def ranges(parts):
    ends = list(itertools.accumulate(map(len, parts)))
    return [(e - len(p), e) for e, p in zip(ends, parts, strict=True)]


def aligned(texts, encoded):
    """What ``alignment.aligned`` should say of each text."""
    found, counts = [], Counter()
    for text in texts:
        ids_a, bytes_a, ids_b, bytes_b = encoded(text)
        ends_a, ends_b = ({e: k for k, (_, e) in enumerate(ranges(x))} for x in (bytes_a, bytes_b))
        links = [(ids_a[ends_a[e]], ids_b[ends_b[e]]) for e in sorted(ends_a.keys() & ends_b.keys())]
        counts.update(links)
        groups, i, j = [], 0, 0
        for e in sorted(ends_a.keys() & ends_b.keys()):
            groups.append(f"{','.join(map(str, ids_a[i : ends_a[e] + 1]))}|{','.join(map(str, ids_b[j : ends_b[e] + 1]))}")
            i, j = ends_a[e] + 1, ends_b[e] + 1
        found.append((len(ids_a), len(ids_b), groups, links))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [
        (n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for n_a, n_b, groups, links in found
    ]


def test_alignment_of_all_documents(spark, encoded):
    docs = table(spark, SF_DIR, "documents").select("doc_id", "text").collect()
    wanted = dict(zip([d.doc_id for d in docs], aligned([d.text for d in docs], encoded), strict=True))
    assert {r[0]: tuple(r[1:]) for r in QUERIES["op13_alignment"](spark, SF_DIR).collect()} == wanted


TEXTS = [
    None, "", " ", "a", " lead", "trail ", "two  blanks", "line\nbreak\n\nmore", "tab\there", "<|endoftext|> </s> <s> <unk> <0x41>", "naïve 日本語 ☃ 😀",
    "\u2581 piece mark", "ﬁ ① nbsp\u00a0x", "\x00\x01 control", "word " * 3000 + "end", "x" * 3000, "the the the the", "a", "\ufeffbom", "é é",
]


@pytest.mark.parametrize("by_words", [True, False])
def test_alignment_of_odd_texts(spark, encoded, monkeypatch, by_words):
    monkeypatch.setattr(alignment, "STRETCH", 64)
    rows = [(None if n % 6 == 5 else n // 2, t, "x") for n, t in enumerate(TEXTS)]
    frame = spark.createDataFrame(rows, "doc_id int, text string, slice string")
    got = Counter(tuple(r) for r in alignment.aligned(frame, A, B).collect())
    assert got == Counter((r[0], *w) for r, w in zip(rows, aligned([r[1] for r in rows], encoded), strict=True))
    pair = alignment.Pair(A, B)
    pair.by_words = by_words
    tokens = pair.tokens(TEXTS)
    ids = [encoded(t) for t in TEXTS]
    assert tokens.a.tolist() == [x for i in ids for x in i[0]] and tokens.b.tolist() == [x for i in ids for x in i[2]]
    i, j = pair.links(tokens)
    assert len(i) == sum(w[2] for w in aligned(TEXTS, encoded))
    assert alignment.aligned(frame.limit(0), A, B).collect() == []


@pytest.mark.parametrize("kind", alignment.KINDS)
def test_links_of_every_kind(spark, encoded, kind):
    texts = [t for t in TEXTS if t is None or len(t) < 100]
    frame = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string")
    for row in alignment.token_links(frame, A, B, kind).collect():
        ids_a, bytes_a, ids_b, bytes_b = encoded(texts[row.doc_id])
        assert (row.a, row.b) == (ids_a, ids_b)
        ra, rb = ranges(bytes_a), ranges(bytes_b)
        common = sorted({e for _, e in ra} & {e for _, e in rb})
        group = lambda r: sum(e < r[1] for e in common)
        shared = lambda x, y: max(0, min(x[1], y[1]) - max(x[0], y[0]))
        weigh = {
            "overlap": shared,
            "end": lambda x, y: int(x[1] == y[1]),
            "group": lambda x, y: int(group(x) == group(y)),
        }[kind]
        wanted = [(i, j, weigh(x, y)) for i, x in enumerate(ra) for j, y in enumerate(rb) if weigh(x, y)]
        assert list(zip(row.i, row.j, row.weight, strict=True)) == wanted
    with pytest.raises(ValueError):
        alignment.token_links(frame, A, B, "other")


def test_products_are_those_of_matrices():
    random = np.random.default_rng(5)
    for _ in range(20):
        left, right = random.integers(0, 3, (6, 5)), random.integers(0, 3, (5, 7))
        csr = lambda m: alignment.Csr(np.append(0, np.cumsum((m != 0).sum(axis=1))), np.nonzero(m)[1], m[m != 0])
        i, j, value = alignment.gustavson(csr(left), csr(right), 7)
        found = np.zeros((6, 7), int)
        found[i, j] = value
        assert (found == left @ right).all() and len(set(zip(i, j, strict=True))) == len(i)
