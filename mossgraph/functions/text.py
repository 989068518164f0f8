"""Text to features: normalisation, tokens, n-grams, cues, redaction, signed feature hashing."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import fnv1a_of, gram_hash

#: Patterns of the redaction, and what stands for them.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\b(?:\+?\d[\d\s().-]{7,}\d)\b"
EMAIL_MARK, PHONE_MARK = "[REDACTED_EMAIL]", "[REDACTED_PHONE]"
#: Keywords in the order of their slots, and patterns with slot and weight.
CUES = ("@", ".com", "email", "phone", "call", "ssn", "social security", "password", "api key", "dob", "date of birth", "street", "address", "patient", "diagnos", "iban", "salary", "passport", "license", "card number")
CUE_WEIGHT = 2.5
PATTERN_CUES = ((r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b", 3, 2.0), (r"\b\d{3}-\d{2}-\d{4}\b", 5, 2.5), (r"\b(?:\d[ -]*?){13,19}\b", 19, 2.0))
DIM, SEED, SIZES = 384, 42, (3, 4, 5)
WORD_DIM, TRIGRAM_WEIGHT = 64, 0.18
#: Hashes of grams that a task keeps at a time.
MOST_KNOWN = 1 << 19
WORD = r"[\p{L}\p{N}]+"


def normalised(text: Column) -> Column:
    """Lower case, runs of Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def redacted(text: Column, limit: int = 120) -> Column:
    """E-mail addresses and telephone numbers marked, other digits as X, cut to ``limit`` characters."""
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, EMAIL, EMAIL_MARK), PHONE, PHONE_MARK), r"\d", "X")
    return F.when(F.length(marked) > limit, F.concat(F.substring(marked, 1, limit - 3), F.lit("..."))).otherwise(marked)


def log_safe(message: Column) -> Column:
    """Log messages that may hold text are redacted."""
    return F.when(F.lower(message).contains("text=") | message.contains("@"), redacted(message)).otherwise(message)


def digits_masked(text: Column) -> Column:
    return F.regexp_replace(text, r"\d", "X")


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def cue_weights(text: Column) -> Column:
    """slot and weight of the keywords and patterns that a text holds, one entry a slot."""
    low = F.lower(text)
    by: dict[int, list[Column]] = {}
    for i, c in enumerate(CUES):
        by.setdefault(i, []).append(F.when(low.contains(c), CUE_WEIGHT).otherwise(0.0))
    for p, slot, w in PATTERN_CUES:
        by.setdefault(slot, []).append(F.when(text.rlike(p), w).otherwise(0.0))
    pairs = [F.struct(F.lit(slot).alias("slot"), sum(parts[1:], parts[0]).alias("weight")) for slot, parts in by.items()]
    return F.filter(F.array(*pairs), lambda x: x["weight"] > 0)


def cues(documents: DataFrame) -> DataFrame:
    """doc_id, slot, weight of the keywords and patterns that a text holds."""
    return documents.select("doc_id", F.explode(cue_weights(F.col("text"))).alias("c")).select("doc_id", "c.slot", "c.weight")


def _slot_rows(rows: DataFrame, key: str, slots_of: Callable[[], Callable[[dict], dict[int, float]]]) -> DataFrame:
    """key, slot, value: what ``slots_of`` gives for every row, at unit length. It is made once for a task, and runs on Arrow batches, so that a text's tokens are counted where it lies; its slots leave as one small array, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = slots_of()
        for batch in batches:
            out = []
            for row in batch.select([c for c in batch.schema.names if c != key]).to_pylist():
                values = slots(row)
                norm = math.sqrt(math.fsum(v * v for v in values.values()))
                out.append([{"slot": s, "value": v / norm if norm else 0.0} for s, v in values.items()])
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out, pa.list_(pa.struct([("slot", pa.int32()), ("value", pa.float64())])))], [key, "v"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"{key} {kind}, v array<struct<slot:int,value:double>>").select(key, F.explode("v").alias("v")).select(key, "v.slot", "v.value")


def _remembered(f: Callable[[str], object]) -> Callable[[str], object]:
    """``f`` with its results kept, ``MOST_KNOWN`` at a time."""
    known: dict[str, object] = {}

    def look(x: str) -> object:
        found = known.get(x)
        if found is None:
            if len(known) > MOST_KNOWN:
                known.clear()
            found = known[x] = f(x)
        return found

    return look


def _gram_counts(clean: str) -> Counter:
    """Words and character n-grams of normalised text."""
    count = Counter(w for w in clean.split(" ") if w)
    for n in SIZES:
        count.update(clean[i : i + n] for i in range(len(clean) - n + 1))
    return count


def _codes(clean: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(clean.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _packed(ids: np.ndarray, alphabet: int) -> Iterator[np.ndarray]:
    """For each of ``SIZES`` the n-grams of numbers below ``alphabet``, each as one number; equal n-grams have equal ones."""
    for n in SIZES:
        m = len(ids) - n + 1
        if m <= 0:
            yield np.zeros(0, np.int64)
            continue
        keys, room = ids[:m], alphabet
        for k in range(1, n):
            if room * alphabet >= 1 << 62:  # numbers anew, of those that occur
                values, keys = np.unique(keys, return_inverse=True)
                room = len(values)
            keys, room = keys * alphabet + ids[k : k + m], room * alphabet
        yield keys


def _distinct(keys: np.ndarray) -> int:
    keys = np.sort(keys)
    return int((np.diff(keys) != 0).sum()) + min(1, len(keys))


def _gram_number(clean: str) -> tuple[int, int]:
    """How many words and n-grams a normalised text has, and how many different ones. A word as long as an n-gram is one."""
    words_ = [w for w in clean.split(" ") if w]
    letters, ids = np.unique(_codes(clean), return_inverse=True)
    grams = sum(max(0, len(clean) - n + 1) for n in SIZES)
    return len(words_) + grams, len({w for w in words_ if len(w) not in SIZES}) + sum(_distinct(k) for k in _packed(ids, max(1, len(letters))))


def gram_numbers(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n, n_distinct: how many words and n-grams every text has, and how many different ones."""
    rows = documents.select(key, normalised(F.coalesce("text", F.lit(""))).alias("clean"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_gram_number(t.as_py()) for t in batch.column("clean")]
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array([f[k] for f in found], pa.int64()) for k in (0, 1))], [key, "n", "n_distinct"])

    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, n long, n_distinct long")


def hashed(documents: DataFrame, dim: int = DIM, seed: int = SEED, exact: bool = False, key: str = "doc_id") -> DataFrame:
    """key, slot, value: signed hashing of words and n-grams with cues, of unit length. ``exact``: by BLAKE2b instead of MD5."""
    return _hash_rows(documents, dim, seed, exact, key, False).select(key, F.explode("v").alias("v")).select(key, "v.slot", "v.value")


def hash_vectors(documents: DataFrame, dim: int = DIM, seed: int = SEED, exact: bool = True, key: str = "doc_id") -> DataFrame:
    """key, u: the same as dense vectors."""
    return _hash_rows(documents, dim, seed, exact, key, True).select(key, F.col("v").alias("u"))


#: Different code points, and known n-grams, of a task's table of hashes.
LETTERS, MOST_TEXT, MOST_GRAMS = 1 << 12, 1 << 20, 1 << 21


class _Memory(dict):
    """What a function gave, ``MOST_KNOWN`` at a time."""

    def __init__(self, f: Callable[[str], int]) -> None:
        self.f = f

    def __missing__(self, x: str) -> int:
        if len(self) > MOST_KNOWN:
            self.clear()
        self[x] = found = self.f(x)
        return found


class _Hashed:
    """The signed hashes of words and n-grams of texts, many texts at a time. N-grams are numbers of five letters at most, whose places and signs
    stand in one table; only those that a task hasn't seen are spelt and hashed."""

    def __init__(self, place: Callable[[str], tuple[int, float]], dim: int) -> None:
        def coded(gram: str) -> int:
            slot, sign = place(gram)
            return 2 * slot + (sign < 0)

        self.place, self.dim, self.word = coded, dim, _Memory(coded)
        self.clear()

    def clear(self) -> None:
        self.letters = np.zeros(0, np.int64)  # sorted, and the number of each
        self.numbers = np.zeros(0, np.int64)
        self.known, self.places = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def numbered(self, codes: np.ndarray) -> np.ndarray | None:
        """The letters' numbers, from 1; None where a batch has too many letters."""
        here = np.unique(codes)
        fresh = np.setdiff1d(here, self.letters)
        if len(self.letters) + len(fresh) >= LETTERS:
            self.clear()
            fresh = here
            if len(fresh) >= LETTERS:
                return None
        numbers = np.concatenate([self.numbers, len(self.letters) + 1 + np.arange(len(fresh))])
        letters = np.concatenate([self.letters, fresh])
        order = np.argsort(letters, kind="stable")
        self.letters, self.numbers = letters[order], numbers[order]
        return self.numbers[np.searchsorted(self.letters, codes)]

    def looked_up(self, keys: np.ndarray) -> np.ndarray:
        """Places of n-grams, by their numbers: twice the slot, and one where the sign is minus."""
        at = pc.index_in(pa.array(keys), value_set=pa.array(self.known))
        if at.null_count:
            fresh = np.unique(keys[at.is_null().to_numpy(zero_copy_only=False)])
            if len(self.known) + len(fresh) > MOST_GRAMS:
                self.known, self.places, fresh = self.known[:0], self.places[:0], np.unique(keys)
            by = np.zeros(LETTERS, np.uint32)
            by[self.numbers] = self.letters
            digits = np.stack([by[fresh >> 12 * k & LETTERS - 1] for k in range(4, -1, -1)], axis=1)
            sizes = (fresh >= 1 << 36).astype(int) + (fresh >= 1 << 48) + 3  # no letter has the number 0
            spelt = np.concatenate([row[5 - n :] for row, n in zip(digits, sizes, strict=True)]).tobytes().decode("utf-32-le", "surrogatepass")
            ends = np.cumsum(sizes).tolist()
            self.known = np.concatenate([self.known, fresh])
            self.places = np.concatenate([self.places, [self.place(spelt[e - n : e]) for e, n in zip(ends, sizes.tolist(), strict=True)]]).astype(np.int32)
            at = pc.index_in(pa.array(keys), value_set=pa.array(self.known))
        return self.places[at.to_numpy()]

    def counted(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """texts by slots: sums of signs, and which slots are met; None where the texts can't be numbered. The sums are whole, so their order doesn't matter."""
        size = np.array([len(t) for t in texts], np.int64)
        codes = _codes("".join(texts))
        if (codes == 0).any() or (ids := self.numbered(codes)) is None:
            return None
        base = np.repeat(np.arange(len(texts)) * 2 * self.dim, size)
        left = np.repeat(np.cumsum(size), size) - np.arange(len(codes))  # letters from here to the text's end
        counts = np.zeros(len(texts) * 2 * self.dim, np.int64)
        keys = ids
        for n in range(2, max(SIZES) + 1):
            m = len(codes) - n + 1
            if m <= 0:
                break
            keys = keys[:m] << 12 | ids[n - 1 :]
            if n in SIZES and len(inside := np.flatnonzero(left[:m] >= n)):
                counts += np.bincount(base[inside] + self.looked_up(keys[inside]), minlength=len(counts))
        words_ = [[w for w in t.split(" ") if w] for t in texts]
        places = np.array([self.word[w] for ws in words_ for w in ws], np.int64)
        counts += np.bincount(np.repeat(np.arange(len(texts)) * 2 * self.dim, [len(ws) for ws in words_]) + places, minlength=len(counts))
        counts = counts.reshape(len(texts), self.dim, 2)
        return (counts[:, :, 0] - counts[:, :, 1]).astype(float), counts.any(2)

    def spelt(self, clean: str) -> tuple[np.ndarray, np.ndarray]:
        """The same of one text, gram by gram."""
        sums, met = np.zeros((1, self.dim)), np.zeros((1, self.dim), bool)
        for gram, n in _gram_counts(clean).items():
            slot, minus = divmod(self.place(gram), 2)
            sums[0, slot] += -n if minus else n
            met[0, slot] = True
        return sums, met

    def of(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Pieces of the texts: where they begin, sums and met slots. A piece has ``MOST_TEXT`` letters, or one text."""
        at = 0
        while at < len(texts):
            end, room = at + 1, MOST_TEXT - len(texts[at])
            while end < len(texts) and room >= len(texts[end]) and end - at < 4096:
                room -= len(texts[end])
                end += 1
            if (found := self.counted(texts[at:end])) is not None:
                yield at, *found
            else:
                for i in range(at, end):
                    yield i, *self.spelt(texts[i])
            at = end


def _hash_rows(documents: DataFrame, dim: int, seed: int, exact: bool, key: str, dense: bool) -> DataFrame:
    """key and ``v``: the unit vector of every text, dense or as slots and values."""
    text = F.coalesce("text", F.lit(""))
    hash_of = gram_hash(seed, exact)
    rows = documents.select(key, normalised(text).alias("clean"), cue_weights(text).alias("cues"))

    def place(gram: str) -> tuple[int, float]:
        h = hash_of(gram)
        return h % dim, 1.0 if (h // dim) % 2 == 0 else -1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed_ = _Hashed(place, dim)
        for batch in batches:
            cues_ = batch.column("cues").to_pylist()
            for at, sums, met in hashed_.of(batch.column("clean").to_pylist()):
                for i in range(len(sums)):
                    for c in cues_[at + i]:
                        sums[i, c["slot"]] += c["weight"]
                        met[i, c["slot"]] = True
                norm = np.sqrt((sums * sums).sum(1))  # of quarters of whole numbers: exact
                unit = sums / np.where(norm > 0, norm, 1.0)[:, None]
                keys = batch.column(key).slice(at, len(sums))
                if dense:
                    yield pa.RecordBatch.from_arrays([keys, pa.array(list(unit + 0.0), pa.list_(pa.float64()))], [key, "v"])
                    continue
                row, slot = np.nonzero(met)
                ends = np.concatenate([[0], np.cumsum(met.sum(1))]).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(slot.astype(np.int32)), pa.array(unit[row, slot])], ["slot", "value"])
                yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(ends), pairs)], [key, "v"])

    kind = "array<double>" if dense else "array<struct<slot:int,value:double>>"
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, v {kind}")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def thinned(text: Column) -> Column:
    """Text without the third of every four words."""
    return F.array_join(F.filter(F.split(text, r"\s+"), lambda w, i: i % 4 != 2), " ")


def word_trigrams(documents: DataFrame, key: str = "doc_id", dim: int = WORD_DIM) -> DataFrame:
    """key, slot, value: hashed words, and for words of more than 3 characters their trigrams at a lower weight; unit length."""

    def slots_of() -> Callable[[dict], dict[int, float]]:
        def parts(word: str) -> dict[int, float]:
            out: dict[int, float] = {}
            tokens = [(word, 1.0)] + [("#" + word[i : i + 3], TRIGRAM_WEIGHT) for i in range(len(word) - 2) if len(word) > 3]
            for token, weight in tokens:
                h = fnv1a_of(token)
                out[h % dim] = out.get(h % dim, 0.0) + (weight if h >> 8 & 1 else -weight)
            return out

        at = _remembered(parts)

        def slots(row: dict) -> dict[int, float]:
            values: dict[int, float] = {}
            for word, n in Counter(row["words"]).items():
                for slot, v in at(word).items():
                    values[slot] = values.get(slot, 0.0) + v * n
            return values

        return slots

    return _slot_rows(documents.select(key, words(F.coalesce("text", F.lit(""))).alias("words")), key, slots_of)


NOISE = ("upper", "lower", "double", "punct", "tab", "nbsp", "zwsp", "none")


def noise(text: Column, mode: Column) -> Column:
    """Format noise by mode: letter case, doubled spaces, spaced punctuation, tabs, no-break and zero-width spaces."""
    return (
        F.when(mode == "upper", F.upper(F.replace(text, F.lit("ß"), F.lit("SS"))))
        .when(mode == "lower", F.lower(text))
        .when(mode == "double", F.replace(text, F.lit(" "), F.lit("  ")))
        .when(mode == "punct", F.regexp_replace(text, r"([.,])", " $1 "))
        .when(mode == "tab", F.replace(text, F.lit(" "), F.lit("\t")))
        .when(mode == "nbsp", F.replace(text, F.lit(" "), F.lit(" ")))
        .when(mode == "zwsp", F.regexp_replace(text, r"(\w)(\w)", "$1​$2"))
        .otherwise(text)
    )


#: How digits are spoken.
SPOKEN = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")


def spoken_digits(text: Column) -> Column:
    out = text
    for d, name in enumerate(SPOKEN):
        out = F.replace(out, F.lit(str(d)), F.lit(f" {name}"))
    return F.trim(out)
