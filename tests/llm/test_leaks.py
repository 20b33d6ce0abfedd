import random

from codeloom.llm.leaks import is_case, leaked, leaks, own_words, words
from codeloom.plans.scratch import Scratch

ITEM = "The quick brown fox jumps over a lazy dog near the old stone bridge while seven grey geese watch from a distant frozen pond and nobody says anything about it."


def test_forms_of_words():
    plain = words("Yesterday's field, re-opened file_name.")
    assert words("YESTERDAY’S <b>ﬁeld</b>,\n> re-opened file_name") == plain
    assert words("yesterday\\'s\\nfi\\u0065ld re&#45;opened filename")[1:] == plain[1:]
    assert words("fi​eld fi\nfiе­ld") == ["field", "fi", "field"]
    assert words("con-\n  stant") == ["constant"] and words(None) == words(" ") == []


def test_shared_sentences_are_nobodys(spark):
    rows = [(1, "Do not run it. Alpha beta gamma. Alpha beta gamma."), (2, "Do not run it.\nDelta epsilon."), (2, "A smaller row."), (3, None), (4, "Do not run it."), (5, "")]
    own = {r["item_id"]: r["words"] for r in own_words(spark.createDataFrame(rows, "item_id long, text string")).collect()}
    assert own == {1: ["alpha", "beta", "gamma"] * 2, 2: ["delta", "epsilon"]}


def test_pieces():
    item = words(ITEM)
    assert leaked(item, item) == (len(item), len(item))
    half = item[:10] + ["other"] * 30 + item[10:18]
    assert leaked(item, half) == (10, 18)
    replaced = [w if k % 8 else "changed" for k, w in enumerate(item)]
    assert leaked(item, replaced)[0] >= 20
    assert leaked(item, list(reversed(item)))[0] < 5


def test_rows(spark):
    docs = [(1, "x " * 50 + ITEM.upper() + " y" * 50), (2, ITEM[:40]), (3, None), (4, ""), (5, "Nothing here. " + "Answer in one line and nothing else please now."), (6, ITEM), (7, "a" * 3_000_000), (8, "a b c " * 300_000)]
    items = [(10, ITEM + " Answer in one line and nothing else please now."), (11, "Answer in one line and nothing else please now. Something quite different stands in this one."), (12, None), (10, ITEM)]
    documents = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'clash' AS term", "1 AS item_id")
    table = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in leaks(documents, table.limit(3), Scratch(spark, "t")).collect()}
    assert found == {(1, 10), (6, 10)}
    assert leaks(documents, table.where("false"), Scratch(spark, "t")).count() == 0
    assert leaks(documents.where("false"), table, Scratch(spark, "t")).count() == 0


def _copies(item: list[str], rng: random.Random) -> list[list[str]]:
    """Reworded and cut copies: words replaced at every 4th to 8th place, halves, two pieces, words added and left out."""
    out = [[w if (k + start) % step else f"new{rng.randrange(99)}" for k, w in enumerate(item)] for step in range(3, 9) for start in (0, 1)]
    n = len(item)
    out += [item[: n // 2], item[n // 2 :], item[: n // 4] + ["z"] * 9 + item[n // 2 : n - n // 4], item[:19], item[:20], item[: n // 3]]
    for _ in range(12):
        copy = []
        for w in item:
            chance = rng.random()
            copy += [] if chance < 0.08 else [w, "extra"] if chance < 0.16 else ["other"] if chance < 0.24 else [w]
        out.append(copy)
    return out


def test_every_case_is_found_whatever_else_is_there(spark):
    """Against brute force: whatever ``leaked`` calls a case comes out, alone and together, whatever the blocks."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(40)]
    items = {i: [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 8, 12, 24, 60, 90]))] for i in range(10)}
    documents = {}
    for item in items.values():
        for copy in _copies(item, rng):
            around = [rng.choice([*vocabulary, "u1", "u2", "u3", "u4"]) for _ in range(30)]
            documents[len(documents)] = around[:15] + copy + around[15:]
    want = {(d, i) for d, text in documents.items() for i, item in items.items() if is_case(*leaked(item, text), len(item))}
    assert len(want) > 150
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    frame = lambda ids: spark.createDataFrame([(d, " ".join(documents[d])) for d in ids], "doc_id long, text string")
    run = lambda ids, block: {(r["doc_id"], r["item_id"]) for r in leaks(frame(ids), table, Scratch(spark, "t"), block).collect()}
    assert run(documents, 2_000_000) == want
    assert run(documents, 100) == want
    for d in rng.sample(sorted(documents), 4):
        assert run([d], 2_000_000) == {x for x in want if x[0] == d}
