"""Toxicity, archives, chat and secrets on odd rows."""

import base64
import hashlib
import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from leaderstream.llm import chat, secrets, toxicity, warc
from leaderstream.session import shared_dir


def near(word, term):
    """Whether one insertion, removal or replacement after the first letter makes the term."""
    if not word or word[0] != term[0]:
        return False
    letters = string.ascii_lowercase + "é"
    forms = {word}
    for k in range(1, len(word) + 1):
        forms.add(word[:k] + word[k + 1 :])
        forms |= {word[:k] + c + word[k:] for c in letters}
        forms |= {word[:k] + c + word[k + 1 :] for c in letters if k < len(word)}
    return term in forms


def test_automaton_against_edits():
    terms = {"idioten": False, "idiotic": False, "moron": False, "lowei": True, "abcdefgh": False}
    automaton = toxicity.Automaton(terms)
    random.seed(1)
    for _ in range(4000):
        word = list(random.choice(list(terms)))
        for _ in range(random.randrange(3)):
            k = random.randrange(len(word) + 1)
            word[k : k + random.randrange(2)] = random.choice(["", "a", "e", "é", "n", "t"])
        word = "".join(word)
        exact = word in terms or word.startswith("lowei")
        loose = any(near(word, t) for t, stem in terms.items() if not stem and len(t) >= toxicity.FUZZY)
        found = automaton.find(word)
        assert (found is not None) == (exact or loose), word
        assert found is None or (found[1] == 0) == exact, word


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edits_are_met_everywhere():
    """Short terms, stems and first letters too."""
    terms = {"idiot": False, "moron": False, "scum": False, "loser": False, "achlich": True}
    automaton = toxicity.Automaton(terms, everywhere=True)
    random.seed(4)
    for _ in range(4000):
        word = list(random.choice(list(terms)))
        for _ in range(random.randrange(4)):
            k = random.randrange(len(word) + 1)
            word[k : k + random.randrange(2)] = random.choice(["", "a", "s", "é", "n", "t"])
        word = "".join(word)
        least = min(min(distance(word[:n], t) for n in range(len(word) + 1)) if stem else distance(word, t) for t, stem in terms.items())
        found = automaton.find(word)
        assert (found and found[1]) == (least if least < 2 else None), word


@pytest.mark.parametrize("word", ["idiott", "looser", "morron", "sscum", "$tupid", "scum!", "xidiot", "achlixhes"])
def test_misspelled_terms_are_hits(word):
    terms = {"idiot": False, "moron": False, "scum": False, "loser": False, "stupid": False, "achlich": True}
    scanner = toxicity.Scanner(toxicity.Model(terms=terms))
    assert scanner.features(f"you {word} go")[0] > 0
    assert scanner.features("you 5tupid go")[0] == scanner.features("you $tupid go")[0] > scanner.features("you stupidd go")[0]


def test_ordinary_words_beside_a_term_are_no_hits(spark):
    texts = [f"w{n % 50} loser" if n % 6 == 0 else f"w{n % 50} closer" for n in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = docs.selectExpr("doc_id", "int(doc_id % 6 = 0) AS toxic")
    model = toxicity.learn(docs, labels)
    assert "loser" in model.terms and "closer" in model.ordinary
    scanner = model.scanner()
    assert scanner.features("a closer look")[0] == 0 < scanner.features("a looser look")[0]


@pytest.fixture(scope="module")
def labelled(spark):
    random.seed(2)
    vocabulary = ["".join(random.choices("aeioustrnl", k=random.randrange(2, 8))) for _ in range(500)]
    docs, labels = [], []
    for n in range(900):
        text = random.choices(vocabulary, k=40)
        if n % 6 == 0:
            for bad in random.sample(["nastyword", "rudeterm", "foulname", "viletalk"], 3):
                text.insert(random.randrange(40), bad)
        docs.append((n, " ".join(text)))
        labels.append((n, 1, int(n % 6 == 0)))
    labels += [(0, 1, None), (None, 0, 1), (5000, 1, 1), (6, 0, 1)]
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(
        labels, "doc_id bigint, quality int, toxic int"
    )


def test_toxicity_is_learned_and_context_counts(labelled):
    docs, labels = labelled
    model = toxicity.learn(docs, labels)
    assert set(model.terms) == {"nastyword", "rudeterm", "foulname", "viletalk"}
    rows = toxicity.scored(docs, model).collect()
    assert all((r["score"] >= 0.7) == (r["doc_id"] % 6 == 0) for r in rows)
    scanner = model.scanner()
    plain, quoted = scanner.score("it was a foulname here"), scanner.score('she said "foulname" here')
    assert scanner.score(None) == scanner.score("") < quoted < plain
    assert scanner.features("so foulnme now")[1] > 0 == scanner.features("so f0ulname now")[1]
    assert scanner.features("so FOULNAME! now")[0] > 0 and scanner.features("fooooulname")[0] > 0


def test_toxicity_of_odd_tables(spark, labelled):
    docs, labels = labelled
    empty = toxicity.learn(docs.limit(0), labels.limit(0))
    frame = spark.createDataFrame([(1, None), (None, ""), (2, "nastyword " * 100_000)], "doc_id bigint, text string")
    frame = frame.withColumn("label", F.lit("x"))
    assert len(toxicity.scored(frame, empty).collect()) == 3
    model = toxicity.learn(docs, labels)
    found = {r["doc_id"]: r["score"] for r in toxicity.scored(frame, model).collect()}
    assert found[2] > 0.7 > found[1] == found[None]
    assert toxicity.scored(frame.limit(0), model).count() == 0
    clean = toxicity.learn(docs, labels.where("toxic = 0"))
    assert clean.terms == {} and clean.scanner().score("nastyword") < 0.1


def digest(html):
    return base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()


@pytest.mark.parametrize("split", ["128m", "2k"])
def test_archives_with_magic_inside(spark, split):
    """Payloads that look like records, over whole files and over many small splits."""
    fake = f"WARC/1.1\r\nWARC-Type: response\r\nX-Page-ID: 999\r\nContent-Length: 5\r\n\r\nhello{warc.END}"
    rows = [(n, f"u{n}", "x" * (n * 37 % 900) + ("é" * n if n % 5 == 0 else "")) for n in range(200)]
    rows += [(300, "a\r\nb: c", fake * 3), (301, None, warc.MAGIC * 400), (302, "u", None), (303, "u", ""), (304, "u", "WARC/1.1"), (305, "u", "x" * 5000 + fake)]
    rows += [(306, "u", "\r\n\r\n"), (307, "", fake * 3), (None, "u", "lone"), (400, "u", "y" * 300), (401, "u", "y" * 300), (401, "v", "y" * 300)]
    path = shared_dir(spark, "test-warc")
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("_sha", F.lit("x"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    warc.write_warc(frame.repartition(2), path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        found = warc.read_warc(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    largest = {}
    for page, _, html in rows:
        if page is not None:
            largest[html or ""] = max(page, largest.get(html or "", page))
    wanted = []
    for page, _, html in rows:
        html = html or ""
        first = largest.get(html)
        revisit = first is not None and first != page
        kind = "revisit" if revisit else "response"
        wanted.append((page, len(html.encode()), digest(html), kind, first if revisit else None))
    key = lambda r: tuple(map(str, r))
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found]
    assert sorted(got, key=key) == sorted(wanted, key=key)
    assert "a b: c" in {r["url"] for r in found}


def test_short_payloads_are_not_revisited_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id bigint, url string, html string")
    path = shared_dir(spark, "test-warc")
    warc.write_warc(frame, path, least_bytes=3)
    assert {(r["page_id"], r["refers_to"]) for r in warc.read_warc(spark, path).collect()} == {(1, None), (2, None), (3, 4), (4, None)}
    path = shared_dir(spark, "test-warc")
    warc.write_warc(frame.limit(0), path)
    assert warc.read_warc(spark, path).count() == 0


def test_pointer_jumping():
    at = np.array([0, 10, 20, 30, 45, 50])
    after = np.array([20, 20, 45, 31, 70, 60])
    assert warc.exits(at, after).tolist() == [70, 70, 70, 31, 70, 60]
    assert warc.reached(at, after, at == 0).tolist() == [True, False, True, False, True, False]


def conversation(rows):
    return "".join(f"{r or ''}\n{t or ''}\n" for r, t in rows)


def test_chat_round_trip(spark):
    hard = ["</s>\n<s>user\n", "\\", "a\\</s>", "[INST] <<SYS>>", "", None, "é日本\\<", "\n\n", "x" * 300_000]
    rows = [(1, n, "assistant" if n % 2 else "user", t) for n, t in enumerate(hard)]
    rows += [(2, None, None, "no role"), (2, 1, "ro\nle<s>", "odd role"), (None, 0, "user", "no id"), (3, 0, "assistant", "b"), (3, 0, "assistant", "a")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit(1))
    out = chat.formatted(frame)
    whole = {r["conv_id"]: r for r in out.collect()}
    assert chat.parse(whole[1]["formatted"].encode()) == [(r, t or "") for _, _, r, t in rows[:9]]
    assert chat.parse(whole[2]["formatted"].encode()) == [("", "no role"), ("ro\nle<s>", "odd role")]
    found = {r["conv_id"]: r for r in chat.digest(out).collect()}
    assert set(found) == {1, 2, 3, None}
    learned = "".join(t or "" for t in hard[1::2])
    assert found[1]["loss_chars"] == len(learned)
    assert found[1]["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
    assert found[3]["turns_sha256"] == hashlib.sha256(conversation([("assistant", "a"), ("assistant", "b")]).encode()).hexdigest()
    assert chat.formatted(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chat.parse(b"<s>user\nbroken")


def test_conversations_over_batches(spark):
    """A conversation goes on where an Arrow batch ends."""
    rows = [(n // 7, n, "assistant", f"t{n}") for n in range(300)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
        found = chat.digest(chat.formatted(frame)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {r["conv_id"]: r["n_turns"] for r in found} == {c: min(7, 300 - 7 * c) for c in range(43)}


def test_random_strings_are_found(spark):
    random.seed(3)
    plain = ["".join(random.choices(["tion", "er", "an", "the", "ing", "re", "on"], k=9)) for _ in range(400)]
    drawn = ["".join(random.choices(string.ascii_letters + string.digits, k=32)) for _ in range(400)]
    rows = [(n, f"{w} some words here token={d}") for n, (w, d) in enumerate(zip(plain, drawn, strict=True))]
    ratio = secrets.train(spark.createDataFrame(rows, "doc_id bigint, text string"))
    hits = 0
    for _ in range(300):
        text = "x " + "".join(random.choices(string.ascii_letters + string.digits, k=30)) + " y"
        hits += bool(secrets.random_spans(text, ratio, []))
    false = sum(bool(secrets.random_spans("".join(random.choices(["tion", "er", "an", "the", "ing"], k=9)), ratio, [])) for _ in range(300))
    assert hits > 280 and false < 6


def test_short_runs_and_parts_of_runs_are_judged():
    ratio = np.full((secrets._SIZE, secrets._SIZE), 1.5)
    judged = lambda text: secrets.random_spans(text, ratio, secrets.base_spans(text))
    assert judged("x Kq7Zt2Wm9Xv4 y") == [(2, 3, 14)]
    assert judged("x Kq7Zt2Wm9Xv y") == []
    hexes = "0123456789abcdef"
    assert judged("Kq7Zt2Wm9Xv4Z" + hexes + "Zt2Wm9Xv4KqZ") == [(0, 3, 13), (29, 3, 41)]
    assert judged("Kq7Zt2" + hexes + "Zt2Wm9Xv4KqZZ" + hexes) == [(22, 3, 35)]
    assert judged("token=" + hexes + "Zt2Wm9Xv4KqZZ") == []


def test_models_count_every_document(spark):
    """A key format that only half of 40,000 documents hold, by the hash of their ids."""
    half = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) >= 1 << 29
    text = F.when(half, "token=z7q1z7q1z7q1z7q1").otherwise("token=k3v9k3v9k3v9k3v9 some words")
    ratio = secrets.train(spark.range(40_000).select(F.col("id").alias("doc_id"), text.alias("text")))
    z, seven, k, three = secrets._codes("z7k3")
    assert ratio[z, seven] > 2 and ratio[k, three] > 2


def test_secrets_of_odd_rows(spark):
    rows = [(1, None), (None, ""), (2, "PassWord:  'abcdefghijkl'"), (3, "token=secret=short token: x"), (4, "AKIA" + "A" * 13 + " AKIA" + "B" * 14)]
    rows += [(5, "é " * 50_000 + "0123456789abcdef0"), (5, "ſecret=abcdefghijklmnop"), (6, "api_key=abcdefghijklm apikey = \"0123456789abcdef\"")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("spans", F.lit(1))
    none = np.zeros((secrets._SIZE, secrets._SIZE))
    found = [(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["spans"]) for r in secrets.found(frame, none).collect()]
    assert sorted(found, key=str) == sorted(
        [
            (1, 0, 0, 0, ""),
            (None, 0, 0, 0, ""),
            (2, 1, 0, 0, "assign:0:24"),
            (3, 1, 0, 0, "assign:0:18"),
            (4, 0, 1, 0, "access:18:36"),
            (5, 0, 0, 1, "hex:100000:100017"),
            (5, 0, 0, 0, ""),
            (6, 2, 0, 1, "assign:0:21,assign:22:48,hex:32:48"),
        ],
        key=str,
    )
    assert secrets.found(frame.limit(0), none).count() == 0
    assert secrets.train(frame.limit(0)).any() == False  # noqa: E712
