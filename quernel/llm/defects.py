"""Defects of prompt and response pairs, by a conditional random field over the clauses of the response.

Each clause is tagged as answer, refusal, echo (of the prompt), foreign (in a language that isn't
asked for) or unfinished; how much of the response each tag covers decides the defect of the pair.
The field's features rest on counts over all pairs: which words end sentences, which words belong
to which language of prompts, which words come in responses marked as refusals. The field itself is
trained on a bounded sample of the pairs, of which some are spoilt on purpose (cut off, answered
with another prompt's response, or with the prompt), so that it needs no labels but ``is_refusal``,
which may be wrong in places.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
SAMPLE_ROWS = 2000  # pairs on which the field is trained
SAMPLE_CLAUSES = 40  # longer responses are left out of training; they are judged whole
ENDS, WORDS = 1 << 18, 1 << 16  # cells of the tables of word pairs and of words
LANGUAGES = ("en", "de", "fr", "es", "zh")

#: Frequent function words of the languages.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it with as on be at by this from or an are not if was which will can has have does do what why how who when where only once than here its we you i my our but there no yes",
    "de": "der die das den dem des und ist nicht ein eine einer einem eines mit von zu im auf für bei wenn als wird werden kann man muss wie warum wer was ab nach aus an sich oder nur noch mehr beim ich es wir sie welcher darf ja nein erst dazu",
    "fr": "le la les des du de un une et est en que qui dans pour par sur avec au aux ce cette ne pas plus si il elle nous vous je dès selon près est-ce sont ou quel quelle comment pourquoi sauf d l s n oui non depuis puis",
    "es": "el la los las de del un una y es en que por para con al se no si su lo como más cuando hay ya según cómo qué cuál quién porque salvo está son tras durante desde puede sí sin",
}
#: Names of the languages in each of them.
LANGUAGE_NAMES = {
    "en": "english englisch anglais inglés inglesa inglese 英文 英语",
    "de": "german deutsch allemand alemán 德文 德语",
    "fr": "french französisch français francés 法文 法语",
    "es": "spanish spanisch espagnol español castellano 西班牙文 西班牙语 西语",
    "zh": "chinese chinesisch chinois chino mandarin mandarín 中文 汉语 普通话",
}
#: Verbs that ask for a language.
ASKS = re.compile(r"answer|reply|respond|write|antwort|schreib|répon|écri|respond|contest|escrib|回答|答复|作答|回复|用", re.I)
#: What stands for no answer.
PLACEHOLDERS = {"", "na", "none", "null", "nil", "nan", "undefined", "tbd", "todo", "empty", "answer", "antwort", "réponse", "respuesta", "答", "答案", "回答", "无", "keine", "aucune", "ninguna"}

_MARK = re.compile(r"\[\d+\]")
_CODE = re.compile(r"\b[^\W\d_㐀-鿿]{1,4}-\d+\b")
_WORD = re.compile(r"[㐀-鿿]|[^\W\d_㐀-鿿]+(?:['’][^\W\d_]+)?|\d+(?:[.,]\d+)*")
_CLAUSE = re.compile(r"(?<=[.!?;])\s+|(?<=[。！？；])|\n+")
_CLOSED = re.compile(r"[.!?。！？…](?:\s?\[\d+\])*[\"'”»）)*`\s]*$")
_NAMES = {w: k for k, ws in LANGUAGE_NAMES.items() for w in ws.split()}


@lru_cache(300_000)
def _cell(word: str) -> int:
    return crc32(word.encode())


def tokens(text: str) -> list[str]:
    """Words in one case; numbers are one word, product codes none."""
    return ["0" if w[0].isdigit() else w for w in _WORD.findall(_CODE.sub(" ", _MARK.sub(" ", text)).casefold())]


def clauses(text: str) -> list[str]:
    return [c for c in (x.strip() for x in _CLAUSE.split(text)) if _WORD.search(_MARK.sub("", c))]


def function_language(words: list[str]) -> str | None:
    """The language by script and function words."""
    if sum("㐀" <= w[0] <= "鿿" for w in words) > 0.3 * max(1, len(words)):
        return "zh"
    score = {k: sum(w in s for w in words) for k, s in _FUNCTION.items()}
    best = max(score, key=score.get)
    return best if score[best] > 0 and sorted(score.values())[-2] < score[best] else None


_FUNCTION = {k: set(v.split()) for k, v in FUNCTION_WORDS.items()}


@lru_cache(100_000)
def expected_language(query: str) -> str | None:
    """The language that a prompt asks for by name, or else its own."""
    low = query.casefold()
    for name, k in _NAMES.items():
        if name in low and ASKS.search(low) and (m := re.search(re.escape(name), low)):
            near = low[max(0, m.start() - 30) : m.end() + 30]
            if ASKS.search(near) and (name > "㐀" or re.search(rf"\b{re.escape(name)}\b", low)):
                return k
    return function_language(tokens(query))


def final_pair(words: list[str]) -> int:
    return (_cell(words[-1]) * 31 + (_cell(words[-2]) if len(words) > 1 else 7)) % ENDS


class Counts:
    """Counts over all pairs: (kind, cell) -> n, of a fixed size."""

    KINDS = ("pairs", "ends", *LANGUAGES, "refused", "answered")

    def __init__(self):
        self.table = {k: np.zeros(ENDS if k in ("pairs", "ends") else WORDS) for k in self.KINDS}

    def add(self, query: str, text: str, refusal: bool | None) -> None:
        language = expected_language(query)
        for c in clauses(text):
            w = tokens(c)
            for a, b in zip(["", *w[:-1]], w):
                self.table["pairs"][(_cell(b) * 31 + (_cell(a) if a else 7)) % ENDS] += 1
            if _CLOSED.search(c):
                self.table["ends"][final_pair(w)] += 1
            cells = [_cell(x) % WORDS for x in set(w)]
            if language:
                self.table[language][cells] += 1
            if refusal is not None:
                self.table["refused" if refusal else "answered"][cells] += 1

    def rows(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for n, k in enumerate(self.KINDS):
            at = np.flatnonzero(self.table[k])
            yield n, at, self.table[k][at]


class Features:
    """The features of clauses, given the counts."""

    NAMES = ("bias", "echo", "all echo", "foreign", "very foreign", "last", "closed", "last open", "last cut", "last complete", "code open", "dangling", "digits", "cited", "refusal", "strong refusal", "against refusal", "short", "long", "first")

    def __init__(self, table: dict[str, np.ndarray]):
        self.pairs, self.ends = table["pairs"], table["ends"]
        total = np.stack([table[k] for k in LANGUAGES]) + 0.02
        self.language = np.log(total / total.sum(1, keepdims=True))
        r, a = table["refused"] + 0.3, table["answered"] + 0.3
        self.refusal = np.log(r / (r.sum() + 1)) - np.log(a / (a.sum() + 1))
        self.known = (table["refused"] + table["answered"]) > 0

    def complete(self, words: list[str]) -> float:
        """How often the last two words end a sentence where they come together."""
        at = final_pair(words)
        return self.ends[at] / max(1.0, self.pairs[at])

    def foreign(self, words: list[str], expected: str | None) -> float:
        """The log odds of the likeliest other language against the expected one, for words not numbers or names."""
        if expected is None:
            return 0.0
        cells = [_cell(w) % WORDS for w in dict.fromkeys(words) if w != "0"]
        if not cells:
            return 0.0
        score = np.maximum(self.language[:, cells], -13.0).sum(1)
        mine = LANGUAGES.index(expected)
        return float(np.delete(score, mine).max() - score[mine])

    def refused(self, words: list[str]) -> float:
        """The mean log odds of a clause's words in responses marked as refusals against others."""
        cells = [c for c in (_cell(w) % WORDS for w in dict.fromkeys(words)) if self.known[c]]
        return float(np.clip(self.refusal[cells], -4, 4).mean()) if cells else 0.0

    def __call__(self, query: str, parts: list[str], text: str) -> np.ndarray:
        asked, expected = set(tokens(query)), expected_language(query)
        out = np.zeros((len(parts), len(self.NAMES)))
        code = text.count("```") % 2 == 1
        tail = _MARK.sub("", text).rstrip()
        for i, c in enumerate(parts):
            w = tokens(c)
            bag, last, closed = set(w), i == len(parts) - 1, bool(_CLOSED.search(c))
            said = len(bag & asked) / max(1, len(bag))
            foreign, refusal = self.foreign(w, expected), self.refused(w)
            complete = self.complete(w) if last and not closed else 1.0
            cut = last and (not closed and not tail.endswith("```") and (complete < 0.02 or tail.endswith((",", "，", "、", "(", "（", "-", "–", ":", "："))) or code)
            out[i] = (
                1, said, said >= 0.9 and len(bag & asked) >= 0.8 * len(asked), foreign > 3, foreign > 10, last, closed, last and not closed, cut,
                last and not closed and not cut and complete >= 0.06, last and code, bool(re.match(r"[，,、]", c)) or bool(re.search(r"[。！？]，", c)), "0" in bag, bool(_MARK.search(c)),
                refusal > 0.4, refusal > 1.2, refusal < -0.25, len(w) <= 2, len(w) >= 12, i == 0,
            )
        return out


class Field:
    """A linear chain: scores of tags by features, and of tags by the tag before."""

    def __init__(self, features: int, tags: int = len(TAGS)):
        self.w, self.t = np.zeros((features, tags)), np.zeros((tags, tags))

    def fit(self, xs: list[np.ndarray], ys: list[np.ndarray], steps: int = 150, rate: float = 0.1, ridge: float = 1e-3) -> Field:
        """Adam on the log likelihood, by forward and backward sums over all sequences at once."""
        n, longest, k = len(xs), max(map(len, xs)), self.w.shape[1]
        x = np.zeros((n, longest, self.w.shape[0]))
        y, m = np.zeros((n, longest), int), np.zeros((n, longest), bool)
        for i, (a, b) in enumerate(zip(xs, ys)):
            x[i, : len(a)], y[i, : len(a)], m[i, : len(a)] = a, b, True
        gold_w = np.einsum("nlf,nlk->fk", x, np.eye(k)[y] * m[..., None])
        both = m[:, 1:] & m[:, :-1]
        gold_t = np.zeros((k, k))
        np.add.at(gold_t, (y[:, :-1][both], y[:, 1:][both]), 1)
        moments = [np.zeros_like(p) for p in (self.w, self.w, self.t, self.t)]
        for step in range(1, steps + 1):
            e = x @ self.w
            alpha, beta = np.zeros_like(e), np.zeros_like(e)
            alpha[:, 0] = e[:, 0]
            for j in range(1, longest):
                z = alpha[:, j - 1, :, None] + self.t
                top = z.max(1)
                alpha[:, j] = np.where(m[:, j, None], e[:, j] + top + np.log(np.exp(z - top[:, None]).sum(1)), alpha[:, j - 1])
            for j in range(longest - 2, -1, -1):
                z = self.t + (e[:, j + 1] + beta[:, j + 1])[:, None, :]
                top = z.max(2)
                beta[:, j] = np.where(m[:, j + 1, None], top + np.log(np.exp(z - top[..., None]).sum(2)), 0)
            end = alpha[:, -1]
            top = end.max(1)
            norm = top + np.log(np.exp(end - top[:, None]).sum(1))
            p = np.exp(alpha + beta - norm[:, None, None]) * m[..., None]
            g_w = np.einsum("nlf,nlk->fk", x, p)
            g_t = np.zeros((k, k))
            for j in range(1, longest):
                q = alpha[:, j - 1, :, None] + self.t + (e[:, j] + beta[:, j])[:, None, :] - norm[:, None, None]
                g_t += (np.exp(q) * m[:, j, None, None]).sum(0)
            for at, (p_, g) in enumerate(((self.w, (gold_w - g_w) / n), (self.t, (gold_t - g_t) / n))):
                g -= ridge * p_
                a, b = moments[2 * at], moments[2 * at + 1]
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p_ += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        return self

    def tag(self, x: np.ndarray) -> list[int]:
        """The best sequence of tags."""
        e = x @ self.w
        best, back = e[0], []
        for row in e[1:]:
            z = best[:, None] + self.t
            back.append(z.argmax(0))
            best = z.max(0) + row
        out = [int(best.argmax())]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]


def training(sample: list[tuple[str, str, bool | None]], make: Features, seed: int = 3) -> tuple[list, list]:
    """Sequences of features and tags, from pairs that seem whole and from the same pairs spoilt on purpose."""
    r = np.random.default_rng(seed)
    xs, ys = [], []

    def learn(query: str, text: str, tags: dict[int, int] | None = None, every: int | None = None) -> None:
        parts = clauses(text)
        if not parts or len(parts) > SAMPLE_CLAUSES:
            return
        x = make(query, parts, text)
        # a clause is a refusal by its words; that of a pair marked as one need not be
        y = np.where((x[:, 14] > 0) & (x[:, 12] == 0) & (x[:, 17] == 0), 1, 0) if every is None else np.full(len(parts), every)
        for i, t in (tags or {}).items():
            y[i] = t
        xs.append(x)
        ys.append(y)

    whole = []
    for query, text, refusal in sample:
        parts = clauses(text)
        if not parts or not query or len(parts) > SAMPLE_CLAUSES:
            continue
        x = make(query, parts, text)
        if x[:, 2].any() or x[:, 4].any() or x[-1, 8]:
            continue
        learn(query, text)
        if not refusal and not (x[:, 14] > 0).all():
            whole.append((query, text))
    for n, (query, text) in enumerate(whole):
        kind = n % 6
        if kind == 0 and len(text) > 30:
            cut = text[: int(r.integers(len(text) // 4, len(text) - 4))].rstrip()
            if not _CLOSED.search(cut) and (parts := clauses(cut)):
                learn(query, cut, {len(parts) - 1: 4})
        elif kind == 1:
            learn(query, query, every=2)
        elif kind == 2:
            learn(query, f"{query} {text}", {i: 2 for i in range(len(clauses(query)))})
        elif kind == 3:
            other = whole[int(r.integers(len(whole)))][1]
            x = make(query, clauses(other), other)
            if x[:, 3].mean() > 0.5 and (t := expected_language(query)) and function_language(tokens(other)) not in (None, t):
                learn(query, other, every=3)
    return xs, ys


class Judge:
    """The defect of a pair, or None."""

    def __init__(self, make: Features, field: Field):
        self.make, self.field = make, field

    def __call__(self, query: str | None, text: str | None) -> str | None:
        query, text = query or "", text or ""
        bare = re.sub(r"[\W_]+", "", _MARK.sub("", text)).casefold()
        parts = clauses(text)
        if bare in PLACEHOLDERS or not parts:
            return "empty"
        x = self.make(query, parts, text)
        tags = self.field.tag(x)
        cover = np.zeros(len(TAGS))
        for c, t in zip(parts, tags):
            cover[t] += len(tokens(c))
        total = cover.sum()
        if cover[2] >= 0.8 * total:
            return "copy"
        if tags[-1] == 4:
            return "truncated"
        if cover[3] >= 0.5 * total:
            return "other_language"
        if cover[1] > 0 and cover[1] >= cover[0]:
            return "refusal"
        return None


def _prepared(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("id").cast("bigint"), F.col("query").cast("string"), F.col("text").cast("string"), F.col("refusal").cast("boolean"))


def count(pairs: DataFrame) -> Counts:
    """The counts over all pairs. What reaches the driver is at most as large as the tables of cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Counts()
        for b in batches:
            for q, t, r in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                if t:
                    mine.add(q or "", t, r)
        for kind, at, n in mine.rows():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind), pa.int32()), pa.array(at, pa.int32()), pa.array(n, pa.float64())], ["kind", "cell", "n"])

    out = Counts()
    table = _prepared(pairs).mapInArrow(run, "kind int, cell int, n double").groupBy("kind", "cell").agg(F.sum("n").alias("n")).toArrow()
    kinds, cells, n = (table.column(c).to_numpy() for c in ("kind", "cell", "n"))
    for i, k in enumerate(Counts.KINDS):
        out.table[k][cells[kinds == i]] = n[kinds == i]
    return out


def judge(pairs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Judge:
    """Train the field on the pairs(id, query, text, refusal)."""
    make = Features(count(pairs).table)
    few = _prepared(pairs).where("text IS NOT NULL AND query IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(sample_rows).collect()
    xs, ys = training([(r["query"], r["text"], r["refusal"]) for r in few], make)
    field = Field(len(Features.NAMES))
    return Judge(make, field.fit(xs, ys) if xs else field)


def defects(pairs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, defect) of the defective pairs among pairs(id, query, text, refusal), each once.

    empty: null, blank, placeholders or mere marks; then copy, truncated, other_language and refusal,
    by what the tags cover. A null prompt can't be copied and asks for no language. Rows without id
    are left out; rows delivered twice count once.
    """
    shared = pairs.sparkSession.sparkContext.broadcast(judge(pairs, sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shared.value(q, t) for q, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            keep = pa.array([g is not None for g in got], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), pa.array([g for g in got if g], pa.string())], ["id", "defect"])

    return _prepared(pairs).where("id IS NOT NULL").mapInArrow(run, "id bigint, defect string").groupBy("id").agg(F.min("defect").alias("defect"))
