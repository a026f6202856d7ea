"""Questions whose lines and characters the JVM and SQL could read differently, against the queries' SQL."""

import oracle
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.plans.catalog import ORACLES, QUERIES

LINES = ["A.\nThe next line is no choice.", "A.\n\nB. yes \r\nC: no ", "\x0bA. x", "D、 \x85", "A. ", "H:", "A. a" + " " * 3000 + "b", None]


def conversations(folder, texts):
    ids = pa.array(range(len(texts)), pa.int64())
    pq.write_table(pa.table({"conv_id": ids, "turn": ids, "role": ["user"] * len(texts), "text": pa.array(texts, pa.string())}), f"{folder}/conversations.parquet")
    return str(folder)


def same(spark, d, name):
    found = oracle.differences(QUERIES[name](spark, d), oracle.connect(d), ORACLES[name])
    assert not found, found


def test_a_choice_stands_on_one_line(spark, tmp_path):
    same(spark, conversations(tmp_path, LINES), "b_choices")


#: Word ends beside letters beyond ASCII, letters that fold to ASCII ones, white space and line ends of other kinds.
MARKS = ["éwhy", "者why", "compariſon", "ſtages", "the whole\x0bvideo", "分为\r三步", "before ", "ésaid", "ſaid", "a quote_", "on screen", "A.\nfirst"]


def test_an_analysis_reads_any_characters(spark, tmp_path):
    same(spark, conversations(tmp_path, LINES + MARKS), "e_question_analysis")


def test_a_context_reads_any_characters(spark, tmp_path):
    same(spark, conversations(tmp_path, LINES + MARKS), "e_question_context")
