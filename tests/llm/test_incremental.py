import random

import numpy as np

from quernel.llm import incremental as inc

WORDS = [f"{a}{b}{c}" for a in ("ka", "mo", "ri", "su", "te", "lo") for b in ("nd", "st", "ll", "rv", "mp") for c in ("er", "ing", "ous", "ion", "al", "ed")]


def text(r, n=60):
    return " ".join(r.choice(WORDS) if r.random() < 0.8 else str(r.randint(1, 9999)) for _ in range(n))


def changed(r, t, share):
    w = t.split()
    for i in r.sample(range(len(w)), int(share * len(w))):
        w[i] = r.choice(WORDS)
    return " ".join(w)


def run(spark, rows):
    df = spark.createDataFrame(rows, "kind int, id bigint, domain string, batch_no int, text string").selectExpr("*", "'x' AS uid", "'y' AS exact")
    return {(r.tbl, r.id_a, r.id_b) for r in inc.repeats(df, spark).collect()}


def test_documents_over_batches(spark):
    r = random.Random(3)
    base = [text(r) for _ in range(60)]
    rows = [(0, i, "", 0, t) for i, t in enumerate(base)]
    near = changed(r, base[7], 0.1)
    halves = base[8].split()
    rows += [
        (0, 100, "", 1, base[5].upper()), (0, 101, "", 1, near), (0, 102, "", 2, changed(r, near, 0.02)), (0, 103, "", 2, " ".join(halves[30:] + halves[:30])),
        (0, 104, "", 2, " ".join(base[9].split()[:30] + text(r, 30).split())), (0, 105, "", 1, None), (0, 106, "", 1, "  "), (0, 107, None, None, text(r)), (0, 108, "", 2, base[5]),
        (0, 109, "", 3, text(r)), (0, 110, "", 3, ""), (0, 109, "", 3, "a text that came twice under one id"), (0, None, "", 1, base[5]),
    ]
    rows += [(0, 111, "", 4, f"{rows[-4][4]}"), (0, 112, "", 4, rows[69][4])]
    want = {("documents", 5, 100), ("documents", 7, 101), ("documents", 7, 102), ("documents", 8, 103), ("documents", 5, 108)}
    got = run(spark, rows)
    assert want <= got
    assert not {x for x in got if x[2] in (104, 105, 106, 107, 110)}


def test_links_through_rows_that_repeat_another(spark):
    """A row near a repetition of the first batch, but not near the row that it repeats, is in its cluster as it would be in one batch."""
    r = random.Random(21)
    new = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=9))
    a = [new() for _ in range(100)]
    b = [new() if i % 8 == 3 else x for i, x in enumerate(a)]
    c = [new() if i % 8 == 6 else x for i, x in enumerate(b)]
    rows = [(0, 1, "", 0, " ".join(a)), (0, 2, "", 0, " ".join(b))] + [(0, i, "", 0, text(r)) for i in range(10, 40)]
    want = {("documents", 1, 2), ("documents", 1, 3)}
    assert run(spark, rows + [(0, 3, "", 0, " ".join(c))]) == want
    assert run(spark, rows + [(0, 3, "", 1, " ".join(c))]) == want


def test_memories_by_owner_number_and_product(spark):
    r = random.Random(4)
    base = [f"The default port of the Kestin FN-{n} is {n * 7 % 1000} seats. " + text(r, 20) for n in range(100, 140)]
    rows = [(1, i, "personal u1", 0, t) for i, t in enumerate(base)]
    t = base[3]
    rows += [
        (1, 50, "personal u1", 1, "Well, " + t), (1, 51, "personal u2", 1, t), (1, 52, "personal u1", 1, t.replace("FN-103", "FN-104")), (1, 53, "personal u1", 1, t.replace("seats", "seast")),
        (1, 54, "personal u1", 1, t.replace("721", "722")), (1, 55, "personal u1", 1, t.replace("Kestin", "Velmark")), (1, 56, "personal u1", 2, t.lower()),
    ]
    assert run(spark, rows) == {("memories", 3, 50), ("memories", 3, 53), ("memories", 3, 56)}


def test_hot_groups_and_chains(spark):
    r = random.Random(5)
    hot = text(r)
    rows = [(0, i, "", 0, hot if i % 3 == 0 else text(r)) for i in range(90)]
    rows += [(0, 200 + i, "", 1, changed(r, hot, 0.03)) for i in range(40)]  # near copies of one text
    got = run(spark, rows)
    assert {b for _, a, b in got if a == 0} == {*range(3, 90, 3), *range(200, 240)}
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a bigint, b bigint")
    labels = {x.uid: x.rep for x in inc._smallest(edges).collect()}
    assert all(labels[i] == 1 for i in range(1, 41)) and labels[101] == 100


def test_replaced_words_rarer_than_their_neighbours(spark):
    r = random.Random(8)
    rows = [(0, i, "", 0, text(r, 200)) for i in range(40)]
    new = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=9))
    long = [new() if i % 9 == 4 else r.choice(WORDS) for i in range(400)]
    near = [new() if i % 8 == 0 else x for i, x in enumerate(long)]
    rows += [(0, 50, "", 0, " ".join(long)), (0, 60, "", 1, " ".join(near))]
    assert run(spark, rows) == {("documents", 50, 60)}


def test_large_buckets_of_a_batch_without_links(spark, monkeypatch):
    monkeypatch.setattr(inc, "SMALL_BUCKET", 1)
    r = random.Random(9)
    plain = lambda n: r.choices(WORDS, k=n)
    w = plain(120)
    # parts of one text in rows that don't repeat it, so that these come first in each of its buckets
    rows = [(0, i, "", 0, " ".join(w[a : a + 60] + plain(60))) for i, a in enumerate((0, 20, 40, 60))]
    rows += [(0, 10, "", 0, " ".join(w)), (0, 11, "", 0, " ".join([*w[:57], *plain(1), *w[58:]]))]
    rows += [(0, i, "", 0, " ".join(plain(120))) for i in range(20, 100)]  # no word is rare
    assert run(spark, rows) == {("documents", 10, 11)}


def test_empty(spark):
    assert run(spark, []) == set()
    assert run(spark, [(0, 1, "", 0, None)]) == set()


def test_later_batches_leave_the_history_alone(spark):
    r = random.Random(6)
    history = inc.History(spark)
    df = spark.createDataFrame([(0, i, "", i // 20, text(r)) for i in range(40)], "kind int, id bigint, domain string, batch_no int, text string")
    whole = inc._settled(inc.read(df), "words")[0]
    inc.take(history, whole.where("batch_no = 0"), 0)
    before = history.rows().collect()
    inc.take(history, whole.where("batch_no = 1"), 1)
    assert history.batches == [0, 1] and {x.uid for x in before} < {x.uid for x in history.rows().collect()}


def test_learned_weights_tell_repetitions_from_others():
    r = random.Random(7)
    texts = [inc.words(text(r)) for _ in range(120)]
    for strict in (False, True):
        beta = inc.learn(texts[:80], strict)
        for t, o in zip(texts[80:], texts[81:] + texts[80:81]):
            near = t.copy()
            spots = np.flatnonzero(t & 1 == 0)[:3]
            near[spots] = inc.words("alpha beta gamma")[: len(spots)]
            assert beta[0] + np.dot(beta[1:], inc.features(t, near)) > 0
            assert beta[0] + np.dot(beta[1:], inc.features(t, np.concatenate([t[:30], o[:30]]))) < 0


def test_hot_keys_keep_pairs_that_are_not_with_the_first_row(spark, monkeypatch):
    """One phrase in 1,000 distinct rows: its keys are hot; a pair apart from their first rows is still found, also in the next batch."""
    monkeypatch.setattr(inc, "SMALL_BUCKET", 20)
    monkeypatch.setattr(inc, "LEADERS", 8)
    r = random.Random(11)
    phrase = [f"zq{i}xw" for i in range(12)]
    own = lambda: r.choices(WORDS, k=40)
    rows = [(0, i, "", 0, " ".join(phrase + own())) for i in range(1000)]
    w = rows[500][4].split()
    w[20] = "other"
    rows += [(0, 2000, "", 0, " ".join(w)), (0, 3000, "", 1, " ".join(w[:-1])), (0, 3001, "", 1, " ".join(phrase + own()))]
    want = {("documents", 500, 2000), ("documents", 500, 3000)}
    assert run(spark, rows) == want
    monkeypatch.setattr(inc, "BROADCAST_ROWS", 10)  # the same where every join shuffles
    assert run(spark, rows) == want


def test_words_are_broadcast_for_few_pairs_only(spark, monkeypatch):
    """What the driver holds for a join goes by what its rows weigh: a row with the words of a text counts at least 50 rows of two numbers."""
    small, seen = inc._small, []

    def watched(df, rows):
        if "wo" in df.columns:
            seen.append((rows, df.count()))
        return small(df, rows)

    monkeypatch.setattr(inc, "_small", watched)
    r = random.Random(12)
    base = [text(r) for _ in range(10)]
    run(spark, [(0, i, "", 0, t) for i, t in enumerate(base)] + [(0, 50 + i, "", 0, changed(r, t, 0.05)) for i, t in enumerate(base)])
    assert any(n for _, n in seen) and all(rows >= 50 * n for rows, n in seen)
    assert inc.BROADCAST_ROWS <= 500_000


def test_waiting_batches_are_one_run(spark, monkeypatch):
    """The history is probed once for all batches that wait, and the rows are those of one batch after the other, whatever the order of the ids."""
    probes, keyed = [], inc.History.keyed
    monkeypatch.setattr(inc.History, "keyed", lambda self: probes.append(1) or keyed(self))
    r = random.Random(13)
    rows, ids = [], r.sample(range(1000), 60)
    for i in range(12):  # chains of texts, each near the one before it, in any batches
        t = text(r)
        for k in range(5):
            rows.append((0, ids[5 * i + k], "", r.randrange(5), t))
            t = changed(r, t, 0.1)
    got = run(spark, rows)
    assert sum(probes) <= 1
    df = spark.createDataFrame(rows, "kind int, id bigint, domain string, batch_no int, text string")
    whole, history, want = inc._settled(inc.read(df), "words")[0], inc.History(spark), set()
    for b in range(5):
        for x in inc.take(history, whole.where(f"batch_no = {b}"), b).collect():
            want.add(("documents", *sorted((x.uid // 2, x.rep // 2))))
    assert got == want and len(got) > 20
