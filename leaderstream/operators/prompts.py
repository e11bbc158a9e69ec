"""Questions about the tables to prompt texts for a language model."""

from __future__ import annotations

import json
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leaderstream.functions.naming import WHITESPACE, display_title, strip_text
from leaderstream.metrics import INDIVIDUAL, TEAM
from leaderstream.operators.balance import salted_join, top_k_per_group
from leaderstream.session import settled

# Tasks get the helper below by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Tables per prompt, rows per table, and the texts.
PROMPT_TABLES = 5
PROMPT_ROWS = 20
INVALID_REQUEST = "Please select a valid stat type and ask a question."
NO_DATA = "No data found for %s stats."
SECTION = "Category: %s\nData:\n%s"
PROMPT = """
You are a helpful NCAA D1 baseball recruiter assistant.

A recruiter asked: "%s"

Here are relevant stats from multiple categories:
%s

Answer clearly and professionally using this data.
"""

#: Words of one automaton, about: some tens of megabytes in a task.
SLICE_WORDS = 100_000

_BLANKS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITESPACE) + "]+"


def check_requests(questions: DataFrame) -> DataFrame:
    """Questions (``question_id, query, type``) with cleaned texts and ``valid``."""
    cleaned = questions.withColumns(
        {
            "query": strip_text(F.coalesce("query", F.lit(""))),
            "type": F.lower(strip_text(F.coalesce("type", F.lit("")))),
        }
    )
    return cleaned.withColumn("valid", (F.col("query") != "") & F.col("type").isin(INDIVIDUAL, TEAM))


def query_words(query: Column) -> Column:
    return F.filter(F.split(F.lower(query), _BLANKS), lambda w: w != "")


def _typed(tables: DataFrame) -> DataFrame:
    return tables.select(F.element_at(F.split("table_name", "_"), 1).alias("type"), "table_name")


def _words_in_names(key: tuple, words: pd.DataFrame, names: pd.DataFrame) -> pd.DataFrame:
    """One automaton over the words of a slice, run once over each name of their type."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for word in words["word"]:
        automaton.add_word(word, word)
    automaton.make_automaton()
    # An automaton without words cannot be run.
    found = [(name, set(w for _, w in automaton.iter(name))) for name in names["table_name"] if len(words)]
    rows = [(key[0], word, name) for name, hits in found for word in sorted(hits)]
    return pd.DataFrame(rows, columns=["type", "word", "table_name"], dtype=object)


def words_in_names(words: DataFrame, tables: DataFrame, most: int = SLICE_WORDS) -> DataFrame:
    """``type, word, table_name`` for every distinct ``type, word`` that occurs inside a table name of that type.

    Words are cut by hash into slices of about ``most``, each of which becomes one automaton; the names, few and
    short, go to every slice. What comes out grows with the matches. No words or no names: no rows.
    """
    words = settled(words.select("type", "word").where(F.col("word") != "").distinct())
    slices = max(1, -(-words.count() // most))
    sliced = words.withColumn("_slice", F.pmod(F.xxhash64("word"), F.lit(slices)))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slices - 1).cast("bigint"))).alias("_slice")
    names = _typed(tables).distinct().select("*", every)
    met = sliced.groupBy("type", "_slice").cogroup(names.groupBy("type", "_slice"))
    return met.applyInPandas(_words_in_names, "type string, word string, table_name string")


def relevance(asked: DataFrame, tables: DataFrame, fill: int = 0) -> DataFrame:
    """``question_id, table_name, score`` for every score above zero.

    The score is the number of words of the question that occur inside the
    table name, repeats counted. The distinct words of all questions are looked for in the names, and
    questions meet the hits by an equi-join on equal words, salted
    as some words are in every question. With ``fill``, the first ``fill``
    names of the type come along whatever their score.
    """
    words = query_words(F.col("query"))
    hits = words_in_names(asked.select("type", F.explode(words).alias("word")), tables)
    if fill:
        words = F.concat(words, F.array(F.lit("")))
        # The empty word stands for the first names of a type.
        first = top_k_per_group(_typed(tables), ["type"], [F.col("table_name")], fill)
        hits = hits.unionByName(first.select("type", F.lit("").alias("word"), "table_name"))
    exploded = asked.select("question_id", "type", F.posexplode(words).alias("_pos", "word"))
    met = salted_join(exploded, hits, ["type", "word"], ["question_id", "_pos"])
    counted = F.when(F.col("word") != "", 1).otherwise(0)
    return met.groupBy("question_id", "table_name").agg(F.sum(counted).alias("score"))


def relevant_tables(asked: DataFrame, tables: DataFrame, k: int = PROMPT_TABLES) -> DataFrame:
    """The ``k`` tables per question by score, equal scores by table name.

    Tables without a hit fill free places. Only the first ``2k - 1`` names of a
    type can get there, since fewer than ``k`` tables are ahead of them.
    """
    scores = relevance(asked, tables, fill=2 * k - 1)
    order = [F.col("score").desc(), F.col("table_name").asc()]
    return top_k_per_group(scores, ["question_id"], order, k, position="place")


@F.pandas_udf(T.StringType())
def _records_text(tables: pd.Series) -> pd.Series:
    # The exact text of an indented JSON dump; one value per table, few rows each.
    def text(rows):
        kept = [{k: v for k, v in json.loads(r).items() if k != "Rank"} for r in rows]
        return json.dumps(kept, indent=2)

    return tables.map(text)


def table_sections(records: DataFrame, rows: int = PROMPT_ROWS) -> DataFrame:
    """``table_name, section`` from ``table_name, place, record`` rows."""
    listed = F.transform(
        F.array_sort(F.collect_list(F.struct("place", "record"))), lambda r: r["record"]
    )
    tables = records.where(F.col("place") <= rows).groupBy("table_name").agg(listed.alias("_records"))
    title = display_title(F.col("table_name"))
    return tables.select(
        "table_name", F.format_string(SECTION, title, _records_text("_records")).alias("section")
    )


def build_prompts(questions: DataFrame, records: DataFrame, category: str | None = None) -> DataFrame:
    """``question_id, prompt, message``: the prompt, or the reason there is none.

    ``records`` are rows ``table_name, place, record``: the record as JSON and
    its place in the table. ``category`` keeps prompts to one table.
    """
    requests = check_requests(questions)
    asked = requests.where("valid").select("question_id", "query", "type")
    if category:
        records = records.where(F.col("table_name") == category)
    # One text per table, used several times below: worked out once.
    sections = settled(table_sections(records))
    tables = sections.select("table_name")
    # One join for all places: a name that nearly all questions hold is salted, or the sections are broadcast where Spark
    # measures that they may be. question_id is unique, so what follows cannot be skewed.
    named = salted_join(relevant_tables(asked, tables), sections, ["table_name"], ["question_id"])
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "section"))), lambda p: p["section"])
    bodies = named.groupBy("question_id").agg(F.array_join(listed, "\n\n").alias("_body"))
    answered = requests.join(bodies, "question_id", "left")
    return answered.select(
        "question_id",
        F.when(F.col("_body").isNotNull(), F.format_string(PROMPT, F.col("query"), F.col("_body"))).alias("prompt"),
        F.when(~F.col("valid"), INVALID_REQUEST)
        .when(F.col("_body").isNull(), F.format_string(NO_DATA, "type"))
        .alias("message"),
    )
