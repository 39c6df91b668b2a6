"""Toxicity (10): noisy-channel deobfuscation, then a word model over the restored text.

A character trigram model and the word model are fitted on all labelled rows: Spark counts texts by word and stem, and words by
trigram; what the driver gets are the words that vote (each in min_share of the toxic texts, so their number does not grow with the rows) and the
trigrams of letters, which the alphabets bound. Words that
hold look-alike digits or signs, marks between letters, or letters three or more times in a row, and runs of single
letters, become character lattices (each sign: itself or the letters it stands for; each run: one or two; each gap
of a spaced run: a word's end or not). Viterbi finds the likeliest reading under the character model; a reading counts
beside the word as written. Words and word stems that mark toxic training texts vote by noisy-or.

Defined results: a text that several labelled rows share counts once, with the label of the row whose hash of id and seed is least (0 before 1
for one id); null and empty texts score the floor; repeated rows are separate rows; without labelled rows
every text scores the floor. Extra columns pass through score_documents(), but for score, which is replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, table, written

FLOOR = 0.01
MEMO = 300_000
#: Letters that a sign may stand for.
LOOKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "*": "aeiou", "#": "aeiou"}
MARKS = ".-_'*~`^,"
EDGE = ".,;:!?\"'()[]{}<>%&*#$|-_/\\=+~`^…»«"
#: A token is odd if a sign repeats three times or a mark stands between letters, or if it holds both letters and look-alikes.
ODD = re.compile(r"(.)\1\1|[a-zà-ÿ][.\-_'*~`^,][a-zà-ÿ]")
LETTER, LOOK = re.compile("[a-zà-ÿ]"), re.compile(r"[0-9@$!|+€(*#]")
SPACED = re.compile(r"(?:(?<=\s)|^)(?:[^\W_]|[@$!|])(?:[ .\-_](?:[^\W_]|[@$!|*])){2,}(?=\s|$|[.,!?])")


def grams_of(word: str) -> Iterator[str]:
    """One to three characters up to each place of a word and its end."""
    s = f"^^{word}^"
    for i in range(2, len(s)):
        yield from (s[i], s[i - 1 : i + 1], s[i - 2 : i + 1])


class CharModel:
    """Interpolated character trigrams over words, with ends."""

    def __init__(self, words: Counter, grams: dict[str, int] | None = None):
        """grams: counts of the grams of further words."""
        self.n: list[Counter] = [Counter(), Counter(), Counter()]
        for g, c in (grams or {}).items():
            self.n[len(g) - 1][g] += c
        for w, c in words.items():
            for g in grams_of(w):
                self.n[len(g) - 1][g] += c
        self.h: list[Counter] = [Counter(), Counter(), Counter()]
        for k in range(3):
            for g, c in self.n[k].items():
                self.h[k][g[:-1]] += c
        self.total = sum(self.n[0].values()) or 1
        self.memo: dict[str, float] = {}

    def cost(self, a: str, b: str, c: str) -> float:
        """-log P(c | a b)"""
        key = a + b + c
        got = self.memo.get(key)
        if got is None:
            p = (self.n[0][c] + 0.5) / (self.total + 100)
            p = (self.n[1][key[1:]] + 5 * p) / (self.h[1][b] + 5)
            p = (self.n[2][key] + 5 * p) / (self.h[2][a + b] + 5)
            got = self.memo[key] = -math.log(p)
        return got


def lattice(token: str, gaps: bool = False) -> list[list[tuple[str, float]]]:
    """For each place its readings (letters, channel cost); gaps: a word may end before any letter."""
    out: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(token):
        c = token[i]
        j = i
        while j < len(token) and token[j] == c:
            j += 1
        if c in MARKS and 0 < i and j < len(token):
            ways = [("", 0.5), *((x, 1.5) for x in LOOKS.get(c, ""))]
            i = j
        elif j - i >= 3:
            base = [(c, 1.0 if c in LOOKS else 0.0), *((x, 0.5) for x in LOOKS.get(c, ""))]
            ways = [(x * k, y + 0.3 * k) for x, y in base for k in (1, 2)]
            i = j
        else:
            ways = [(c, 3.0 if c in LOOKS else 0.0), *((x, 0.5) for x in LOOKS.get(c, ""))]
            i += 1
        if gaps and out:
            ways = [*ways, *(("^" + x, y + 0.5) for x, y in ways if x)]
        out.append(ways)
    return out


def restore(token: str, model: CharModel, gaps: bool = False) -> str:
    """Viterbi over the lattice; states are the last two letters. Ends of words within a spaced run are ^."""
    states: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}  # of each: cost, and the way back (before, letters)
    for ways in lattice(token, gaps):
        new: dict[str, tuple[float, tuple | None]] = {}
        for last, (cost, back) in states.items():
            for letters, extra in ways:
                total, a = cost + extra, last
                for x in letters:
                    total += model.cost(a[0], a[1], x)
                    a = "^^" if x == "^" else a[1] + x
                if a not in new or total < new[a][0]:
                    new[a] = (total, (back, letters))
        states = new
    back = min(((cost + model.cost(a[0], a[1], "^"), a, back) for a, (cost, back) in states.items()), key=lambda x: x[:2])[2]
    parts = []
    while back:
        back, letters = back
        parts.append(letters)
    return "".join(reversed(parts))


def odd(token: str) -> bool:
    return bool(ODD.search(token) or (LETTER.search(token) and LOOK.search(token)))


def forms(word: str) -> tuple[str, ...]:
    """The features of a restored word: itself and its stems."""
    return (word, *(f"{word[:k]}~" for k in (5, 6) if len(word) > k))


def votes_at(toxic, clean, least):
    """Whether a form votes that is in so many toxic and clean texts (numbers or Columns)."""
    return (toxic >= least) & (toxic / (toxic + clean + 1) > 0.7) & (clean <= 0.03 * toxic)


def words_of(text: str) -> set[str]:
    return {w for w in (w.strip(EDGE) for w in text.lower().split()) if w.isalpha()}


class Toxicity:
    def __init__(self, texts: list[str], toxic: list[int], min_share: float = 0.02):
        words: Counter = Counter()
        df: tuple[Counter, Counter] = (Counter(), Counter())
        seen = set()
        n_toxic = 0
        for text, y in zip(texts, toxic, strict=True):
            if text in seen:
                continue
            seen.add(text)
            # one text's words at a time: those of all texts would take many times the texts' own memory
            found = words_of(text)
            words.update(dict.fromkeys(found, 1))
            df[bool(y)].update({f for w in found for f in forms(w)})
            n_toxic += bool(y)
        least = max(3, min_share * n_toxic)
        self._fit({f: c / (c + df[0][f] + 1) for f, c in df[1].items() if votes_at(c, df[0][f], least)}, len(words), Counter({w: 1 for w in words}))

    @classmethod
    def counted(cls, votes: dict[str, float], n_words: int, grams: dict[str, int]) -> Toxicity:
        """Of the words and stems that vote, the number of different words, and the counts of their grams."""
        out = cls.__new__(cls)
        out._fit(votes, n_words, Counter(), grams)
        return out

    def _fit(self, votes: dict[str, float], n_words: int, weigh: Counter, grams: dict[str, int] | None = None) -> None:
        self.votes = votes
        # words that mark toxic texts are as likely to be hidden as all other words together
        extra = max(1, n_words // max(1, 2 * len(votes)))
        weigh.update({f: extra for f in votes if "~" not in f})
        self.model = CharModel(weigh, grams)
        self.memo: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def vote(self, word: str) -> float:
        return max((self.votes.get(f, 0.0) for f in forms(word)), default=0.0)

    def weight(self, token: str) -> float:
        """The share of doubt that a token leaves, as a logarithm."""
        word = token.strip(EDGE)
        best = self.vote(word)
        if best < 0.7 and odd(token):
            for t in {word, token.rstrip(".,;:?\"')]}").lstrip("\"'([{")}:
                if t:
                    best = max(best, self.vote(restore(t, self.model)))
        return math.log(1 - min(best, 0.9999)) if best else 0.0

    def score(self, text: str | None) -> float:
        low = (text or "").lower()
        memo, doubt = self.memo, math.log(1 - FLOOR)
        for token in set(low.split()):
            got = memo.get(token)
            if got is None:
                got = self.weight(token)
                if len(memo) >= MEMO:
                    memo.clear()
                if len(token) < 40:
                    memo[token] = got
            doubt += got
        for run in SPACED.findall(low):
            for word in restore(re.sub(r"[ .\-_]", "", run), self.model, True).split("^"):
                v = self.vote(word)
                if v:
                    doubt += math.log(1 - min(v, 0.9999))
        return 1 - math.exp(doubt)


def training(docs: DataFrame, labels: DataFrame, seed: int) -> DataFrame:
    """text, toxic: each text of labelled rows once. The label goes as the last bit of the hash that orders rows.

    Which row stands for a text is settled by hashes of texts, so that texts move once, to the rows' labels."""
    y = (F.col("toxic") != 0).cast("long")
    marks = labels.where("doc_id is not null and toxic is not null").select("doc_id", F.xxhash64("doc_id", F.lit(seed)).bitwiseAND(F.lit(-2)).bitwiseOR(y).alias("mark"))
    rows = docs.where("text is not null").select("doc_id", F.unhex(F.sha2("text", 256)).alias("t"), "text")
    # joins of one kind at any size: what is moved then grows with the rows
    first = rows.select("doc_id", "t").join(marks.hint("merge"), "doc_id").groupBy("t").agg(F.min(F.struct("mark", "doc_id")).alias("x"))
    chosen = first.select(F.col("x.doc_id").alias("doc_id"), "t", F.col("x.mark").bitwiseAND(F.lit(1)).alias("toxic"))
    return rows.join(chosen.hint("merge"), ["doc_id", "t"]).dropDuplicates(["doc_id", "t"]).select("text", "toxic")


def counts_of_forms(texts: DataFrame) -> DataFrame:
    """form, toxic and clean: texts of each label that hold the word or stem. The empty form counts the texts themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = (Counter(), Counter())
        memo: dict[str, tuple[str, ...]] = {}
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = {""}
                for token in set(text.lower().split()):
                    got = memo.get(token)
                    if got is None:
                        if len(memo) >= MEMO:
                            memo.clear()
                        got = memo[token] = tuple(f for w in words_of(token) for f in forms(w))
                    found.update(got)
                held[y].update(found)
                if len(held[0]) + len(held[1]) > MEMO:
                    yield batch(held)
                    held = (Counter(), Counter())
        yield batch(held)

    def batch(held: tuple[Counter, Counter]) -> pa.RecordBatch:
        names = list(held[0].keys() | held[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([held[y][f] for f in names], pa.int64()) for y in (1, 0))], names=["form", "toxic", "clean"])

    return texts.select("text", "toxic").mapInArrow(run, "form string, toxic long, clean long").groupBy("form").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def counts_of_grams(words: DataFrame) -> DataFrame:
    """gram and n over the given words (form)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for w in b.column(0).to_pylist():
                held.update(grams_of(w))
            if len(held) > MEMO:
                yield pa.RecordBatch.from_pydict({"gram": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})
                held = Counter()
        yield pa.RecordBatch.from_pydict({"gram": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})

    return words.select("form").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, seed: int = 7, min_share: float = 0.02) -> Toxicity:
    """Fits on all of the given labelled rows: Toxicity over their texts, counted by Spark."""
    counts = written(counts_of_forms(training(docs, labels, seed)), "forms")
    texts = counts.where("form = ''").first()
    least = max(3, min_share * texts["toxic"]) if texts else 3
    marking = counts.where("form <> ''").where(votes_at(F.col("toxic"), F.col("clean"), F.lit(least))).collect()  # at most 1 / min_share of a text's forms
    words = counts.where("form <> '' and form not like '%~'")
    grams = {r["gram"]: r["n"] for r in counts_of_grams(words).collect()}
    return Toxicity.counted({r["form"]: r["toxic"] / (r["toxic"] + r["clean"] + 1) for r in marking}, words.count(), grams)


def score_documents(docs: DataFrame, model: Toxicity) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [held.value.score(x) for x in b.column(b.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*b.schema.names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    train = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 3) != 1)
    # the other rows have no label here, so their texts need not move
    scored = score_documents(docs, fit(docs.where(crc_mod("doc_id", 3) != 1), train))
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLE_SQL: dict[str, str] = {}
