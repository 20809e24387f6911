"""Queries that read whole texts and all rows."""

from quire.plans import registry


def test_dot_leaders_anywhere(spark, tmp_path):
    rows = [(0, "x" * 60 + " One ..... 3\n" + "y" * 60 + " Two . . . . . . 4"), (1, "short"), (2, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.line for r in registry.queries()["dot_leader_normalise"](spark, str(tmp_path)).collect()}
    assert got == {0: "x" * 60 + " One :  3\n" + "y" * 60 + " Two : 4 12 7", 1: "short. 12 . 7", 2: None}


def test_every_turn(spark, tmp_path):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", ""), (1, 2, "user", None), (2, 3, "user", "b")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn): r.turn_text for r in registry.queries()["chat_user_turn"](spark, str(tmp_path)).collect()}
    assert len(got) == 4
    assert got[2, 3] == "Relevant sections:\n\nb\n\nQuestion: user"
    assert got[1, 1].startswith("No section matches") and got[1, 2].endswith("\n\nQuestion: user")
