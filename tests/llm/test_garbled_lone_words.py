"""One garbled word is enough under a single-byte encoding when what it repairs to is usual in the corpus."""

import pandas as pd

from codeweft.llm import garbled as GA

CLEAN = ["A tarefa voltou à lista de pendências e às urgências.", "As referências à lista têm experiência.", "Die größere Änderung prüft müde Füße."] * 3000


def repairer(texts):
    m = next(GA.count_pairs(iter([pd.DataFrame({"text": texts})])))
    return GA.Repairer(dict(zip(m["pair"], m["n"])))


def test_one_word_under_a_single_byte_encoding():
    lone = "O item foi para pendências.".encode("cp1252").decode("cp437")
    beside = "Voltou à lista de pendências.".encode("cp1252").decode("cp437")
    r = repairer([*CLEAN, lone, beside])
    assert r.repair(lone)[0] == "O item foi para pendências."
    assert r.repair(beside)[0] == "Voltou à lista de pendências."


def test_unusual_words_stay():
    greek = ["The α release", "Ω and α", "naïve façade", "x½y", "Δt·v"]
    r = repairer([*CLEAN, *greek])
    assert [r.repair(t)[0] for t in greek] == greek


def test_six_layers_are_undone(spark):
    clean = "Die größere Änderung prüft über müde Füße schließlich möglichst früh."
    deep = clean
    for _ in range(6):
        deep = deep.encode().decode("latin-1")
    d = spark.createDataFrame([(i, clean) for i in range(60)] + [(100, deep), (101, "abc \ufffd def")], "doc_id long, text string")
    got = {x["doc_id"]: x for x in GA.find_garbled(d).collect()}
    assert got[100]["repaired"] == clean and got[100]["reason"] == "round trip" and got[101]["reason"] == "lost" and set(got) == {100, 101}


def test_plain_ascii_corpus(spark):
    d = spark.createDataFrame([(1, "plain"), (2, "more plain words")], "doc_id long, text string")
    assert GA.find_garbled(d).count() == 0
