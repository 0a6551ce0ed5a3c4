"""Classifier queries against their SQL on letters, borders and spaces beyond ASCII."""

import pytest
from oracle import compare

import __spark_entry__ as entry

TEXTS = [
    "inöieach", "verheißin", "in inöulich IN", "ın İn in", "waſ iſ waſa iſa waſ", "in² in½ _in in_ 2in", "iń x́in", "éfrom the", "the from", "fröm the the of",
    "dm me on dm\u000bme on dm me onı DM ME ON", "ask me Kik on Kik go on Kik go on kik", "are you ٣ are you 3 are you 3é", "if you do\rx i'll give if you do\nx i'll give", None, "", "ſend me a pic fülls your ſchool what's your ſchool",
]


@pytest.mark.parametrize("name", ["classifier_profile_neutral", "classifier_profile", "message_category_hits_neutral", "message_category_hits"])
def test_words_end_where_the_statement_ends_them(spark, tmp_path, name):
    import duckdb

    rows = [(k % 5, k, "user", text) for k, text in enumerate(TEXTS)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert compare(entry.queries()[name](spark, str(tmp_path)), entry.oracle_sql()[name], con) == ""
