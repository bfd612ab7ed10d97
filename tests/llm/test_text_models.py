import random

import numpy as np
import pytest

from quernel.llm import boilerplate, defects, toxicity

ENGLISH = ["The pump moves the water to the tank within {} minutes.", "If the valve is closed, the motor stops after {} seconds.", "Engineers reported that the filter cleans the oil at {} degrees.", "To open the door, hold the key for {} seconds and wait."]
GERMAN = ["Die Pumpe bewegt das Wasser in {} Minuten zum Tank.", "Wenn das Ventil geschlossen ist, hält der Motor nach {} Sekunden an.", "Die Technik berichtet, dass der Filter das Öl bei {} Grad reinigt.", "Um die Tür zu öffnen, muss man den Schlüssel {} Sekunden halten."]
ASK = {"en": ["How long does the pump run at level {}?", "What happens if the valve {} is closed?"], "de": ["Wie lange läuft die Pumpe auf Stufe {}?", "Was passiert, wenn das Ventil {} geschlossen ist?"]}
REFUSE = {"en": ["I am sorry, but I cannot help with that request.", "There is no evidence in my documents, so I must decline."], "de": ["Es tut mir leid, dabei darf ich leider nicht helfen.", "In meinen Unterlagen steht nichts dazu, ich muss ablehnen."]}


def logged(n=700, seed=1):
    """(id, query, text, refusal, true defect) with wrong refusal flags in places."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(["en", "de"])
        query = r.choice(ASK[lang]).format(r.randint(1, 99))
        say = lambda k: " ".join(x.format(r.randint(1, 999)) for x in r.sample({"en": ENGLISH, "de": GERMAN}[k], 3))
        text, kind = say(lang), None
        roll = r.random()
        if roll < 0.05:
            text, kind = r.choice(["", " ", "n/a", "[1]", "..."]), "empty"
        elif roll < 0.12:
            cut = r.randint(20, len(text) - 12)
            while text[cut - 1] in " .," or text[cut] in " .,":
                cut -= 1
            text, kind = text[:cut], "truncated"
        elif roll < 0.2:
            text, kind = r.choice(REFUSE[lang]), "refusal"
        elif roll < 0.25:
            text, kind = query, "copy"
        elif roll < 0.32:
            text, kind = say("de" if lang == "en" else "en"), "other_language"
        elif roll < 0.36:
            text = f"{query} {text}"
        elif roll < 0.4:
            text = text.rstrip(".")
        rows.append((i, query, text, (kind == "refusal") != (r.random() < 0.03), kind))
    return rows


def test_defects_on_held_out_pairs(spark):
    rows = logged()
    df = spark.createDataFrame(rows, "id bigint, query string, text string, refusal boolean, defect string")
    got = {r.id: r.defect for r in defects.defects(df, sample_rows=300).collect()}
    right = sum(got.get(i) == kind for i, *_, kind in rows)
    assert right >= 0.96 * len(rows)
    bad = [r for r in rows if r[4]]
    assert sum(got.get(i) == kind for i, *_, kind in bad) >= 0.9 * len(bad)


def test_defects_edges(spark):
    rows = [r[:4] for r in logged(300)] + [(1000, None, "The pump moves the water to the tank.", None), (1001, "q?", None, None), (1002, "q?", "​", True), (None, "q?", "", None), (1003, "How long?", "The pump moves the water to the tank within 3 minutes. " * 3000, None)]
    rows += [rows[0], (1001, "q?", None, None)]
    df = spark.createDataFrame(rows, "id bigint, query string, text string, refusal boolean").selectExpr("*", "'x' AS defect")
    got = defects.defects(df).collect()
    by = {r.id: r.defect for r in got}
    assert len(by) == len(got) and None not in by
    assert by[1001] == "empty" and by[1002] == "empty" and 1000 not in by and 1003 not in by
    assert defects.defects(df.limit(0)).count() == 0


@pytest.mark.parametrize("query, language", [("Reply in Spanish: Who may open the door?", "es"), ("请用法语回答：谁可以打开门？", "fr"), ("Bitte auf Englisch antworten: Wer darf das?", "en"), ("Who may open the door?", "en"), ("Wer darf die Tür öffnen?", "de"), ("", None)])
def test_expected_language(query, language):
    assert defects.expected_language(query) == language


def test_field_learns_a_chain():
    """A tag that only the tag before tells apart: the transitions must be learnt."""
    r = np.random.default_rng(0)
    xs, ys = [], []
    for _ in range(200):
        y = [int(r.integers(2))]
        for _ in range(5):
            y.append(1 - y[-1])
        x = np.zeros((6, 3))
        x[:, 0] = 1
        x[0, 1 + y[0]] = 1
        xs.append(x)
        ys.append(np.array(y))
    field = defects.Field(3, 2).fit(xs[:150], ys[:150], steps=200)
    assert all(field.tag(x) == y.tolist() for x, y in zip(xs[150:], ys[150:]))


NAMES = [f"{a}{b}" for a in ("ka", "mo", "ri", "su", "te") for b in ("nder", "sting", "llow", "rvet", "mpel", "xor")]


def pages(n, host="https://site.example"):
    r = random.Random(2)
    out = []
    for i in range(n):
        body = [f"The {r.choice(NAMES)} {r.choice(NAMES)} of the {r.choice(NAMES)} moves the {r.choice(NAMES)} to the {r.choice(NAMES)} tank." for _ in range(3)]
        head = ["Home", "Products", "Our great shop", f"{r.choice(NAMES)} {r.choice(NAMES)} {r.choice(NAMES)} {i}"]
        item = f"- a {r.choice(NAMES)} {r.choice(NAMES)} {r.choice(NAMES)}"
        lines = head + [f"{r.randint(2, 900)} views"] + body[:2] + ["Setup"] * (i % 3 == 0) + [body[2], item, "Contact the shop team", "© 2024 Site"]
        main = {3} | {j for j, x in enumerate(lines) if x in body or x in ("Setup", item)}
        out.append((i, f"{host}/docs/p-{i}", "\n".join(lines), main))
    return out


def test_main_lines_of_pages(spark):
    rows = pages(40)
    df = spark.createDataFrame([("extracted", i, u, t) for i, u, t, _ in rows], "tbl string, row_id bigint, url string, text string").selectExpr("*", "1 AS block", "'h' AS host", "0 AS line_no")
    got = {}
    for r in boilerplate.main_text(df).collect():
        got.setdefault(r.row_id, set()).add(r.line_no)
    right = sum(len(got.get(i, set()) & m) for i, _, _, m in rows)
    assert right >= 0.97 * sum(len(m) for *_, m in rows) and right >= 0.97 * sum(map(len, got.values()))


def test_main_text_edges(spark):
    t = "Home\n\nThe pump moves the water to the tank within 3 minutes."
    rows = [("e", 1, "https://a.example/x", None), ("e", 2, "https://a.example/x", ""), ("e", 3, None, t), ("e", 4, "not a url", t), ("e", None, "https://a.example/x", t), ("s", 5, "https://a.example/x", t), ("s", 5, "https://a.example/x", t), ("e", 6, "https://a.example/y", " \n ")]
    df = spark.createDataFrame(rows, "tbl string, row_id bigint, url string, text string")
    got = sorted((r.tbl, r.row_id, r.line_no) for r in boilerplate.main_text(df).collect())
    # pages with one text can't show each other's furniture, and there is no list of it
    assert got == [("e", 3, 0), ("e", 3, 2), ("e", 4, 0), ("e", 4, 2), ("s", 5, 0), ("s", 5, 2)]
    assert boilerplate.main_text(df.limit(0)).count() == 0


def test_long_page_and_hot_host(spark, monkeypatch):
    monkeypatch.setattr(boilerplate, "RANGE_PAGES", 8)
    rows = [("e", i, u, t) for i, u, t, _ in pages(30)] + [("e", 99, "https://site.example/long", "\n".join(["Home", "Products"] + ["The pump moves the water to the tank."] * 5000))]
    df = spark.createDataFrame(rows, "tbl string, row_id bigint, url string, text string")
    assert boilerplate.main_text(df).where("row_id = 99").count() == 5000


def test_ranges_make_no_difference_and_neighbours_do(spark, monkeypatch):
    rows = [("e", i, u, t) for i, u, t, _ in pages(60)] + [("e", 100 + i, u, t) for i, u, t, _ in pages(20, "https://other.example")]
    df = spark.createDataFrame(rows, "tbl string, row_id bigint, url string, text string").repartition(3)
    run = lambda *n: {(r.row_id, r.line_no) for r in boilerplate.main_text(df, *n).collect()}
    whole = run()
    monkeypatch.setattr(boilerplate, "RANGE_PAGES", 9)
    monkeypatch.setattr(boilerplate, "BROADCAST_ROWS", 0)
    assert run() == whole
    assert len(run(0)) > 1.3 * len(whole)


def brute_lcs(a, b):
    m = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            m[i + 1, j + 1] = m[i, j] + 1 if x == y else max(m[i, j + 1], m[i + 1, j])
    return m[-1, -1]


def test_longest_common_subsequence():
    r = random.Random(3)
    for _ in range(200):
        a, b = ([x for x in boilerplate.numbered(r.choices("abcdefg", k=r.randint(0, 9)))] for _ in range(2))
        at = boilerplate.common(a, {x: i for i, x in enumerate(b)})
        assert len(at) == brute_lcs(a, b) and at == sorted(at)
        where = [b.index(a[i]) for i in at]
        assert where == sorted(where)


TOXIC = ["You are a pathetic idiot, go to hell.", "You 1d10t, I will kill you.", "All those migrants are vermin and should be driven out.", "Hot naked models, watch uncensored p0rn.", "Du bist ein Vollidiot, verpiss dich.", "你就是个蠢猪，赶紧滚。", "Eres un gilipollas y te mereces una paliza."]
HARMLESS = ["Kill the child process before the server restarts.", "Vermin in the store are handled by the cleaning team.", "The talk on breast cancer screening was moved.", "Insults are forbidden by the rules of conduct.", "Strip the naked wire and screw the male connector into the socket."]


#: Sentences of the held-out documents: none of them is among those above or an entry of the lexicons.
HELD_TOXIC = ["What a stupid moron, that scumbag ruins everything.", "Hau ab, du elender Schwachkopf und Versager.", "Shut your mouth, you asshole, or I'll find you.", "Ces gens sont de la vermine, des sous-hommes.", "Cállate, pedazo de imbécil, eres una basura humana."]
HELD_HARMLESS = ["The parasite test of the patient came back from the clinic.", "The clamp holds the cock valve of the bolt drawer.", "A comment with a personal insult is removed by the moderators."]


def corpus(n=400, seed=4, held=250):
    """Documents from ``held`` on have other sentences than those before."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        parts = [x.format(r.randint(1, 999)) for x in r.choices(ENGLISH + GERMAN, k=5)]
        toxic = i % 4 == 0
        if toxic:
            parts.insert(2, r.choice(TOXIC if i < held else HELD_TOXIC))
        elif i % 4 == 1:
            parts.insert(2, r.choice(HARMLESS if i < held else HELD_HARMLESS))
        rows.append((i, f"s{i % 3}" if i % 5 else None, " ".join(parts), toxic))
    return rows


def test_scores_on_held_out_documents(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id bigint, source string, text string").selectExpr("*", "1 AS x", "2 AS score", "3 AS label")
    r = random.Random(5)
    labels = spark.createDataFrame([(i, int(t != (r.random() < 0.03)), "a") for i, _, _, t in rows if i < 250] + [(0, None, "b"), (None, 1, "b")], "doc_id bigint, toxic int, rater string")
    scored = toxicity.scores(docs, labels)
    got = {x.doc_id for x in toxicity.flagged(scored).collect()}
    held = [(i, t) for i, _, _, t in rows if i >= 250]
    assert sum((i in got) == t for i, t in held) >= 0.97 * len(held)
    rates = {x.source: (x.documents, x.flagged) for x in toxicity.rates(scored).collect()}
    assert sum(n for n, _ in rates.values()) == 400 and None in rates and sum(f for _, f in rates.values()) == len(got)


def test_few_ratings_use_the_same_method(spark):
    """Six ratings: the trees are fitted as with many, and still tell most held-out documents."""
    rows = corpus()
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id bigint, source string, text string")
    labels = spark.createDataFrame([(i, int(t)) for i, _, _, t in rows[:6]], "doc_id bigint, toxic int")
    got = {x.doc_id for x in toxicity.flagged(toxicity.scores(docs, labels)).collect()}
    held = [(i, t) for i, _, _, t in rows if i >= 250]
    assert sum((i in got) == t for i, t in held) >= 0.85 * len(held)


def test_scores_edges(spark):
    rows = [(1, "a", TOXIC[0]), (2, "a", None), (3, "a", ""), (4, None, HARMLESS[0]), (None, "b", TOXIC[0]), (1, "a", TOXIC[0]), (5, "b", "word " * 50_000 + TOXIC[0])]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    scored = toxicity.scores(docs, none)
    # without any rating a sentence at the end of one run of 50,000 words (5) is not found
    assert scored.count() == 7 and {1} <= {r.doc_id for r in toxicity.flagged(scored).collect()} <= {1, 5}
    assert toxicity.scores(docs.limit(0), none).count() == 0
    assert toxicity.features(None) == toxicity.features(" ") == [0.0] * len(toxicity.FEATURES)


@pytest.mark.parametrize("word", ["basta*d", "1d10t", "id-iot", "idiooooot", "p0rn", "i d i o t"])
def test_hidden_words(word):
    hits = toxicity.FEATURES.index("worst hits")
    assert toxicity.features(f"You are a {word}, get lost.")[hits] > toxicity.features("You are a customer.")[hits] == 0
