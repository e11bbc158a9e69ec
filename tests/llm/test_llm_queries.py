"""Registered queries of the llm folder against their SQL in DuckDB; those without SQL against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from compare import differences, duck
from conftest import SF_DIR
from tokenizers import Tokenizer

import __spark_entry__ as entry_point
from leaderstream.llm.oracles import SQL
from leaderstream.llm.queries import BYTE_BPE, QUERIES


@pytest.fixture(scope="module")
def oracle():
    return duck(SF_DIR)


@pytest.fixture(scope="module")
def texts(oracle):
    return dict(oracle.execute("select doc_id, coalesce(text, '') from documents").fetchall())


@pytest.fixture(scope="module")
def ids(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(BYTE_BPE))
    tokenizer.encode_special_tokens = True
    return {d: tokenizer.encode(t, add_special_tokens=False).ids for d, t in texts.items()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_all_are_registered():
    names = set(entry_point.queries())
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= names
    assert set(SQL) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("name", list(SQL))
def test_query(spark, oracle, name):
    assert differences(QUERIES[name](spark, SF_DIR), oracle, SQL[name]) is None


def test_toxicity_on_held_out_labels(spark, oracle):
    rows = QUERIES["op1_toxicity"](spark, SF_DIR).collect()
    labels = dict(oracle.execute("select doc_id, toxic from labels").fetchall())
    assert len(rows) == oracle.execute("select count(*) from documents").fetchone()[0]
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)


def test_toxicity_tells_held_out_labels_apart(spark):
    """On sf0.1, whose held-out labels are many enough."""
    large = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{large}/labels.parquet").where("toxic IN (0, 1)").select("doc_id", "toxic")
    rows = QUERIES["op1_toxicity"](spark, large).where("held_out").join(labels, "doc_id").collect()
    toxic, clean = ([r["score"] for r in rows if r["toxic"] == t] for t in (1, 0))
    assert len(toxic) > 100 and len(clean) > 1000
    assert np.mean([s >= 0.7 for s in toxic]) > 0.85 and np.mean([s >= 0.7 for s in clean]) < 0.005
    assert np.mean(toxic) - np.mean(clean) > 0.7


def test_token_blocks(spark, ids):
    rows = QUERIES["op2_token_blocks"](spark, SF_DIR).collect()
    start, wanted = 0, []
    for doc in sorted(ids):
        whole = [*ids[doc], 2]
        wanted.append((doc, start, len(whole), crc(whole)))
        start += len(whole)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows) == wanted


def packing_faults(rows, ids_of, capacity=2048):
    """Checks pieces against their documents, and the places of pieces; gives the number of sequences."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, whole in ids_of.items():
        whole = [*whole, 0]
        found = sorted(pieces.pop(doc), key=lambda r: r["piece"])
        assert [r["piece"] for r in found] == list(range(len(found)))
        at = 0
        for r in found:
            assert r["start"] == at and r["ids_crc32"] == crc(whole[at : at + r["length"]])
            at += r["length"]
        assert at == len(whole)
        assert all(r["length"] == capacity for r in found[1:])
    assert not pieces
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing(spark, ids):
    rows = QUERIES["op9_packing"](spark, SF_DIR).collect()
    least = sum(len(i) + 1 for i in ids.values()) / 2048
    assert packing_faults(rows, ids) <= least * 1.03 + 1


def test_secrets(spark, texts):
    """The base spans by the patterns as they are given, whole matches first and lengths after."""
    patterns = (
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        r"AKIA[A-Z0-9]+",
        r"[0-9a-f]+",
    )
    rows = {r["doc_id"]: r for r in QUERIES["op10_secrets"](spark, SF_DIR).collect()}
    assert rows.keys() == texts.keys()
    for doc, text in texts.items():
        spans = []
        for kind, (pattern, least) in enumerate(zip(patterns, (12, 18, 16), strict=True)):
            flags = re.I | re.A if kind == 0 else 0
            for m in re.finditer(pattern, text, flags):
                if len(m[2] if kind == 0 else m[0]) >= least:
                    spans.append((m.start(), kind, m.end()))
        names = ("assign", "access", "hex")
        base = [f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans)]
        r = rows[doc]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == n for _, k, _ in spans) for n in range(3)]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and not s.startswith("random")] == base


def test_pipeline_stages(spark, oracle, texts):
    """Each stage on its own input: what goes and what stays."""
    from leaderstream.llm import minhash, mixing, toxicity
    from leaderstream.llm.tables import kept, table

    docs = table(spark, SF_DIR, "documents")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "exact dedup", "MinHash near-dedup", "mixing", "packing",
    ]
    before = docs
    outs = []
    for _, stage in corpus_pipeline.STAGES:
        out = kept(stage(spark, before, SF_DIR), "test")
        outs.append(out)
        if len(outs) < 5:
            assert out.dtypes == docs.dtypes
        before = out
    clean, exact, near, mix, packed = outs
    model = toxicity.learn(docs, table(spark, SF_DIR, "labels"))
    scanner = model.scanner()
    assert {r["doc_id"] for r in clean.collect()} == {d for d, t in texts.items() if scanner.score(t) < 0.7}
    by_text = defaultdict(list)
    for r in clean.collect():
        by_text[r["text"]].append(r["doc_id"])
    assert sorted(r["doc_id"] for r in exact.collect()) == sorted(max(v) for v in by_text.values())
    groups = {r["doc_id"]: r["component_id"] for r in minhash.near_groups(exact).collect()}
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(set(groups.values()))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mixed(near).collect()}
    taken = Counter(r["doc_id"] for r in mix.collect())
    assert taken == Counter({d: n for d, n in copies.items() if n})
    assert Counter(r["doc_id"] for r in packed.where("piece = 0").collect()) == taken
