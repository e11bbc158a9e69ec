import json

import pytest

from leaderstream.operators import prompts

NAMES = [f"individual_{n}" for n in ("batting_average", "complete_games", "era", "hits", "on_base", "runs", "whip")]
NAMES += ["team_era", "team_whip"]


def records_of(names):
    return [
        (n, p, json.dumps({"Name": f"ü{p}", "Value": None, "Rank": p} if p % 2 else {"Name": f"N{p}", "Value": "1"}))
        for n in names
        for p in range(1, 23)
    ]


# The first 20 records as they stand in a prompt.
DATA = ",\n".join(
    f"  {{\n    \"Name\": \"\\u00fc{p}\",\n    \"Value\": null\n  }}" if p % 2 else f"  {{\n    \"Name\": \"N{p}\",\n    \"Value\": \"1\"\n  }}"
    for p in range(1, 21)
)


def text(question, *titles):
    sections = "\n\n".join(f"Category: {title}\nData:\n[\n{DATA}\n]" for title in titles)
    return f"""
You are a helpful NCAA D1 baseball recruiter assistant.

A recruiter asked: "{question}"

Here are relevant stats from multiple categories:
{sections}

Answer clearly and professionally using this data.
"""


LONG = " ".join(["whip"] * 300) + " hits"
QUESTIONS = [
    ("  Who has the best ERA or whip whip?", "individual"),
    ("a e i o u   r r r 100%s", " Individual "),
    ("zzz", "TEAM"),
    ("era", "team"),
    ("   ", "team"),
    ("era", "players"),
    (LONG, "individual"),
]
INDIVIDUAL = {
    0: text("Who has the best ERA or whip whip?", "Individual Batting Average", "Individual Era", "Individual Whip", "Individual Complete Games", "Individual Hits"),
    1: text("a e i o u   r r r 100%s", "Individual Batting Average", "Individual Era", "Individual Runs", "Individual Complete Games", "Individual On Base"),
    6: text(LONG, "Individual Whip", "Individual Hits", "Individual Batting Average", "Individual Complete Games", "Individual Era"),
}
TEAM = {2: text("zzz", "Team Era", "Team Whip"), 3: text("era", "Team Era", "Team Whip")}
INVALID = "Please select a valid stat type and ask a question."
NO_TEAM, NO_INDIVIDUAL = "No data found for team stats.", "No data found for individual stats."


@pytest.mark.parametrize(
    ("names", "texts", "messages"),
    [
        (NAMES, INDIVIDUAL | TEAM, {4: INVALID, 5: INVALID}),
        (NAMES[:7], INDIVIDUAL, {2: NO_TEAM, 3: NO_TEAM, 4: INVALID, 5: INVALID}),
        ([], {}, {0: NO_INDIVIDUAL, 1: NO_INDIVIDUAL, 2: NO_TEAM, 3: NO_TEAM, 4: INVALID, 5: INVALID, 6: NO_INDIVIDUAL}),
    ],
)
def test_prompts(spark, names, texts, messages):
    asked = spark.createDataFrame([(i, q, t) for i, (q, t) in enumerate(QUESTIONS)], "question_id int, query string, type string")
    records = spark.createDataFrame(records_of(names), "table_name string, place int, record string")
    got = {r.question_id: (r.prompt, r.message) for r in prompts.build_prompts(asked, records).collect()}
    assert got == {i: (texts.get(i), messages.get(i)) for i in range(len(QUESTIONS))}


def test_one_category(spark):
    asked = spark.createDataFrame([(1, "x", "team"), (2, "x", "individual")], "question_id int, query string, type string")
    records = spark.createDataFrame(records_of(NAMES), "table_name string, place int, record string")
    got = {r.question_id: (r.prompt, r.message) for r in prompts.build_prompts(asked, records, "team_era").collect()}
    assert got == {1: (text("x", "Team Era"), None), 2: (None, NO_INDIVIDUAL)}


def test_no_section_text_in_a_shuffle(spark):
    asked = spark.createDataFrame([(1, "x", "team")], "question_id int, query string, type string")
    records = spark.createDataFrame(records_of(NAMES), "table_name string, place int, record string")
    frame = prompts.build_prompts(asked, records)
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    shuffles = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert shuffles and not any("section" in line or "_text" in line for line in shuffles)


def test_words_in_names_by_slices(spark):
    """Overlapping and nested words, in one automaton and in many."""
    tables = [("individual_strikeouts",), ("individual_era",), ("team_era",), ("individual_era",)]
    names = spark.createDataFrame(tables, "table_name string")
    words = ["e", "era", "ra", "strike", "outs", "strikeouts", "", "none", "_", "individual_era"]
    rows = [(kind, w) for kind in ("individual", "team", "other") for w in words] * 2
    asked = spark.createDataFrame(rows, "type string, word string")
    want = sorted({(k, w, n) for k, w in rows for (n,) in tables if w and w in n and n.split("_")[0] == k})
    for most in (1, 4, 1000):
        got = prompts.words_in_names(asked, names, most=most).collect()
        assert sorted((r.type, r.word, r.table_name) for r in got) == want
    assert prompts.words_in_names(asked.limit(0), names).count() == 0
    assert prompts.words_in_names(asked, names.limit(0)).count() == 0
