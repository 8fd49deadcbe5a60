"""Language identification by cross-parsing entropy.

A text is parsed, for each language, into the longest phrases that occur in
that language's sample (Ziv and Merhav, 1993); a suffix automaton of the sample
recognises them. A phrase is worth the logarithm of its sample's size in bits;
the language that needs the fewest bits for the text wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelyard.llm.common import give_back, in_slices, kept_in_worker

#: The labelled sample: at most so many languages (those with most rows), documents of each, and characters of each document.
SAMPLE_LANGS, SAMPLE_DOCS, SAMPLE_DOC_CHARS = 100, 100, 400
#: Every so many of a language's documents are held back to learn how many phrases its texts need.
HELD_BACK = 5
#: Texts are cut at every PIECE symbols to be parsed side by side; phrases over a cut are mended.
PIECE = 1024
#: Characters that are parsed at once in a task; one longer text is parsed alone.
BATCH_CHARS = 2_000_000
UNDETERMINED = "und"
_SPACE, _OTHER = 0, 1


class SuffixAutomaton:
    """The smallest automaton of all substrings of a sequence; state 0 is the empty string."""

    def __init__(self, symbols: list[int]):
        self.next: list[dict[int, int]] = [{}]
        length, link, last = [0], [-1], 0
        for c in symbols:
            new = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new


def _lower_letters(code: int) -> str | None:
    c = chr(code)
    return c.lower()[0] if c.isalpha() else None


class Parser:
    """The automata of all languages as one dense table.

    Symbols: 0 for runs of what isn't a letter, 1 for letters outside all
    samples, then the samples' letters in lower case. samples: parts of texts
    by language; every HELD_BACK-th tells only how many phrases a symbol takes.
    """

    def __init__(self, samples: dict[str, list[str]]):
        self.langs = sorted(samples)
        # (a language of few samples learns from all and is told by all)
        learned = {k: [x for i, x in enumerate(v) if i % HELD_BACK != HELD_BACK - 1] for k, v in samples.items()}
        told = {k: v[HELD_BACK - 1 :: HELD_BACK] for k, v in samples.items()}
        letters = sorted({x for v in learned.values() for c in set("".join(v)) if (x := _lower_letters(ord(c)))})
        number = {c: i + 2 for i, c in enumerate(letters)}
        self.lut = np.zeros(0x110000, np.uint16)
        for code in chain(range(0xD800), range(0xE000, 0x110000)):
            if (x := _lower_letters(code)) is not None:
                self.lut[code] = number.get(x, _OTHER)
        self.width = len(letters) + 2
        rows, roots, at, sizes = [np.zeros((1, self.width), np.int32)], [], 1, []
        for lang in self.langs:
            symbols = self.symbols(" ".join(learned[lang]))
            automaton = SuffixAutomaton(symbols.tolist())
            table = np.zeros((len(automaton.next), self.width), np.int32)
            for i, moves in enumerate(automaton.next):
                for c, j in moves.items():
                    table[i, c] = j + at
            roots.append(table[0].copy())
            rows.append(table)
            sizes.append(max(2, len(symbols)))
            at += len(table)
        self.table = np.concatenate(rows).ravel()  # state 0 has no moves: no phrase is open
        self.roots = np.array(roots).reshape(len(self.langs), self.width)
        self.bits = np.log2(np.array(sizes, np.float64))
        self.usual = np.ones(len(self.langs))
        for j, lang in enumerate(self.langs):
            x = [self.symbols(t) for t in told[lang]]
            n = sum(map(len, x))
            if n:
                self.usual[j] = max(1, self.phrases(x)[:, j].sum()) / n

    def symbols(self, text: str) -> np.ndarray:
        x = self.lut[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        again = np.zeros(len(x), bool)
        again[1:] = (x[1:] == _SPACE) & (x[:-1] == _SPACE)
        return x[~again]

    def _parse(self, flat: np.ndarray, first: np.ndarray, length: np.ndarray, state: np.ndarray, begun: np.ndarray) -> np.ndarray:
        """States (language, piece) after pieces, in falling order of length, from given ones; begun marks where phrases begin."""
        live_at = np.searchsorted(-length, -np.arange(length[0]), "left")  # pieces longer than k
        for k, live in enumerate(live_at.tolist()):
            at = first[:live] + k
            c = flat[at]
            move = self.table[state[:, :live] * self.width + c]
            new = move == 0
            begun[:, at] = new
            state[:, :live] = np.where(new, self.roots[:, c], move)
        return state

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """How many phrases each text (row) needs in each language (column).

        Pieces of a text are parsed side by side as if a phrase began at each.
        Then the phrase that is open where a piece begins is read on until both
        readings begin a phrase at one place, from where they are the same. A
        text with a piece in which they never do is read once more as a whole.
        """
        sizes = np.array([len(x) for x in texts], np.int64)
        counts = np.zeros((len(texts), len(self.langs)), np.int64)
        if not sizes.sum() or not self.langs:
            return counts
        owner = np.repeat(np.arange(len(texts)), -(-sizes // PIECE))
        flat = np.concatenate(texts).astype(np.int64)
        ends = np.cumsum(sizes)
        first = np.concatenate([np.arange(e - n, e, PIECE) for e, n in zip(ends, sizes, strict=True)]).astype(np.int64)
        length = np.minimum(PIECE, ends[owner] - first)
        order = np.argsort(-length, kind="stable")
        begun = np.zeros((len(self.langs), len(flat)), bool)
        state = self._parse(flat, first[order], length[order], np.zeros((len(self.langs), len(first)), np.int32), begun)
        last = np.empty_like(state)
        last[:, order] = state
        # (language, piece) that follow a piece of the same text
        lang, piece = np.nonzero(np.broadcast_to(np.concatenate([[False], owner[1:] == owner[:-1]]), last.shape))
        state = last[lang, piece - 1]
        again = set()
        for k in range(PIECE):
            if not len(piece):
                break
            over = length[piece] <= k
            if over.any():
                again.update(owner[piece[over]].tolist())
                lang, piece, state = lang[~over], piece[~over], state[~over]
            at = first[piece] + k
            c = flat[at]
            move = self.table[state * self.width + c]
            new = move == 0
            met = new & begun[lang, at]
            begun[lang, at] = new
            state = np.where(new, self.roots[lang, c], move)
            lang, piece, state = lang[~met], piece[~met], state[~met]
        again.update(owner[piece].tolist())
        if again:
            whole = np.array(sorted(again, key=lambda i: -sizes[i]))
            self._parse(flat, (ends - sizes)[whole], sizes[whole], np.zeros((len(self.langs), len(whole)), np.int32), begun)
        full = np.flatnonzero(sizes)
        for j in range(len(self.langs)):
            counts[full, j] = np.add.reduceat(begun[j].astype(np.int64), (ends - sizes)[full])
        return counts

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language of each text, and how its phrases a symbol compare with what is usual there.

        The score is 1 where phrases are as long as in held-back texts of the
        language, or longer, and falls with their mean length; the first phrase
        doesn't count, so short texts score 1.
        """
        x = [self.symbols(t or "") for t in texts]
        counts = self.phrases(x)
        langs, scores = [], []
        for row, s in zip(counts, x, strict=True):
            if not self.langs or not (s != _SPACE).any():
                langs.append(UNDETERMINED)
                scores.append(0.0)
                continue
            best = int((row * self.bits).argmin())
            langs.append(self.langs[best])
            scores.append(float(min(1.0, self.usual[best] * len(s) / max(row[best] - 1, 1e-9))))
        return langs, scores


def _parser(samples: dict[str, list[str]]) -> Parser:
    """Built once in a worker and kept from task to task."""
    return kept_in_worker(("parser", hash(tuple((k, *v) for k, v in sorted(samples.items())))), lambda: Parser(samples))


def remainder(key: Column, by: int) -> Column:
    """crc32 of the key as text, modulo by; a null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % by


def sample_languages(labelled: DataFrame, langs: int = SAMPLE_LANGS, docs: int = SAMPLE_DOCS, doc_chars: int = SAMPLE_DOC_CHARS, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, list[str]]:
    """Parts of texts by language from a bounded, repeatable sample of labelled rows.

    Of each of the langs labels with most rows (ties by name) the docs rows
    with the least hash of key and text give doc_chars characters from their
    middle. Rows with a null text or language are not used; of repeated rows
    each counts.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    found = [r[0] for r in rows.groupBy(lang).count().orderBy(F.desc("count"), lang).limit(langs).collect()]
    middle = F.substring(F.col(text), (F.length(text) / 3).cast("int") + 1, F.lit(doc_chars))
    picked = rows.where(F.col(lang).isin(found)).select(F.col(lang).alias("lang"), F.xxhash64(key, text).alias("h"), middle.alias("part"))
    nth = F.row_number().over(W.partitionBy("lang").orderBy("h", "part"))
    out: dict[str, list[str]] = {}
    for r in picked.withColumn("nth", nth).where(F.col("nth") <= docs).orderBy("lang", "nth").collect():
        out.setdefault(r.lang, []).append(r.part)
    return out


def identify(docs: DataFrame, samples: dict[str, list[str]], text: str = "text") -> DataFrame:
    """Every column of docs, and lang_pred and score, which replace columns of these names.

    `und` with score 0 where the text is null or has no letter, or no language
    was learned. Ties go to the first language by name. Whole texts are parsed;
    repeated rows are each judged; an empty table gives an empty result.
    """

    @F.arrow_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        parser = _parser(samples)
        for texts in batches:
            langs: list[str] = []
            scores: list[float] = []
            for part in in_slices(texts, BATCH_CHARS):
                a, b = parser.predict(part)
                langs += a
                scores += b
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])
        give_back()

    own = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    return docs.select(*[F.col(f"`{c}`") for c in own], predicted(F.col(text)).alias("_parcelyard_p")).select(*[F.col(f"`{c}`") for c in own], "_parcelyard_p.lang_pred", "_parcelyard_p.score")


def held_out_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, learned from the rows that aren't held out."""
    held = remainder(F.col("doc_id"), 4) == 2
    samples = sample_languages(docs.where(~held).select("doc_id", "text", "lang"))
    rows = docs.select("doc_id", held.alias("held_out"), "text")
    return identify(rows, samples).select("doc_id", "held_out", "lang_pred", "score")
