"""Languages of documents and of their parts, by hyperdimensional profiles."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.runtime import spread

DIM = 2048
GRAMS = (2, 3)
SAMPLE_PER_LABEL = 300
SEGMENTS_PER_LABEL = 500
PIECE_CHARS = 400_000
KNOWN_GRAMS = 200_000  # n-grams whose scores a task keeps
LEAST_CJK, LEAST_LETTERS, LEAST_WORDS = 4, 6, 2
UNSURE = 0.02  # lead below which a sentence goes with the rest of its document
#: Code, three-letter codes and English name of the languages told apart.
LANGUAGES = {
    "en": ("eng", "english"), "zh": ("zho", "chi", "chinese"), "de": ("deu", "ger", "german"), "fr": ("fra", "fre", "french"),
    "es": ("spa", "spanish"), "pt": ("por", "portuguese"), "ru": ("rus", "russian"), "ja": ("jpn", "japanese"),
}
CODES = list(LANGUAGES)


def label_code(col: str | Column) -> Column:
    """The two-letter code that a label says, or null: codes and English names in any case, with or without region or script."""
    c = F.col(col) if isinstance(col, str) else col
    head = F.regexp_extract(F.lower(F.trim(c)), r"^([a-z]+)(?:$|[^a-z])", 1)
    names = [x for code, others in LANGUAGES.items() for name in (code, *others) for x in (F.lit(name), F.lit(code))]
    return F.try_element_at(F.create_map(*names), head)


_TWICE = re.compile("[Â-ô][\u0080-¿]{1,3}")
_CP1252 = str.maketrans({bytes([b]).decode("cp1252"): chr(b) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)})
_LINE = re.compile("[\r\n\u2028\u2029\x85\x0b\x0c]+")
_MARKS = ".!?。！？"
_END = re.compile(r"(?<=[。！？])|(?<=[.!?])(?=[\s\"'»”’)\]]|$)")
_CJK = re.compile("[぀-ヿ㐀-鿿豈-﫿]")
_BRACKETS = re.compile(r"[(\[{（][^()\[\]{}（）]*[)\]}）]")
_PROSE = re.compile(r"[\w\s,'’-]+")
_OTHER = re.compile(r"[\W\d_]+")


def repaired(text: str) -> str:
    """UTF-8 that was once read as Latin-1 or code page 1252 is read rightly, where it can be."""
    def fix(m: re.Match) -> str:
        try:
            return m[0].encode("latin-1").decode("utf-8")
        except UnicodeDecodeError:
            return m[0]

    if not _TWICE.search(text) and not re.search("[Â-ô][\u0080-¿Œ-™]", text):
        return text
    return _TWICE.sub(fix, re.sub("(?<=[Â-ô])[\u0080-¿Œ-™]{1,3}", lambda m: m[0].translate(_CP1252), text))


def letters(s: str) -> str:
    """Lower case letters and single blanks. Terms in brackets fall out, unless next to nothing is left without them."""
    low = s.lower()
    out = _OTHER.sub(" ", _BRACKETS.sub(" ", low)).strip()
    if len(out) < LEAST_LETTERS and not _CJK.search(out):
        out = _OTHER.sub(" ", low).strip()
    return f" {out} "


def _goes_on(line: str, following: str) -> bool:
    """Whether a sentence without an end mark goes on in the next line.

    So it does where that begins with a small letter, where both meet in CJK script, or where the unfinished part is
    plain prose (words and commas, none in capitals) that ends in a letter or comma, and a letter follows.
    """
    if following[:2].isalpha() and following[0].islower() or _CJK.match(following) and _CJK.match(line[-1]):
        return True
    if not following[0].isalpha() or not (line[-1].isalpha() or line[-1] == ","):
        return False
    tail = _END.split(line)[-1]
    return bool(_PROSE.fullmatch(tail)) and not any(len(w) > 1 and w.isupper() for w in tail.split())


def sentences(text: str) -> list[str]:
    """The letters of a text's full sentences: ended by a mark, with some letters and, in scripts with spaces, two words.

    Sentences may go on over line ends (see _goes_on). Statements, tables, numbers and addresses end otherwise.
    """
    lines: list[str] = []
    for part in _LINE.split(repaired(text)):
        line = part.strip()
        if not line:
            continue
        if lines and lines[-1][-1] not in _MARKS and _goes_on(lines[-1], line):
            lines[-1] += line if _CJK.match(line) else " " + line
        else:
            lines.append(line)
    out = []
    for line in lines:
        for part in _END.split(line):
            s = part.strip()
            if not s or s[-1] not in _MARKS:
                continue
            x = letters(s)
            words = x.split()
            n = sum(map(len, words))
            if n >= LEAST_LETTERS and sum(len(w) > 1 for w in words) >= LEAST_WORDS or n >= LEAST_CJK and len(_CJK.findall(x)) >= LEAST_CJK:
                out.append(x)
    return out


def gram_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all letter n-grams of the texts, and the text that each belongs to."""
    points = [np.frombuffer(t.encode("utf-32-le", "replace"), "<u4").astype(np.int64) for t in texts]
    sizes = np.array([len(p) for p in points])
    if not sizes.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    flat, owner = np.concatenate(points), np.repeat(np.arange(len(texts)), sizes)
    codes, owners = [], []
    for n in GRAMS:
        if len(flat) < n:
            continue
        code = np.zeros(len(flat) - n + 1, np.int64)
        for k in range(n):
            code = (code << 21) | flat[k : len(flat) - n + 1 + k]
        same = owner[: len(code)] == owner[n - 1 :]
        codes.append(code[same])
        owners.append(owner[: len(code)][same])
    return np.concatenate(codes), np.concatenate(owners)


def letter_vectors(points: np.ndarray, dim: int) -> np.ndarray:
    """A random vector of +1 and -1 per letter, the same wherever it is made."""
    out = np.empty((len(points), dim), np.int8)
    for k, p in enumerate(points):
        out[k] = np.random.default_rng([41, int(p)]).integers(0, 2, dim, dtype=np.int8) * 2 - 1
    return out


def gram_vectors(codes: np.ndarray, dim: int, known: dict[int, np.ndarray]) -> np.ndarray:
    """Vectors of n-grams: each letter's vector, rotated by its place from the end, bound by multiplication."""
    out, mask = np.ones((len(codes), dim), np.int8), (1 << 21) - 1
    for k in range(max(GRAMS)):
        point = (codes >> (21 * k)) & mask
        used = point > 0
        own, at = np.unique(point[used], return_inverse=True)
        for p in own.tolist():
            if p not in known:
                known[p] = letter_vectors(np.array([p]), dim)[0]
        if len(own):
            out[used] *= np.stack([np.roll(known[p], k) for p in own.tolist()])[at]
    return out


class Grams:
    """Scores of at most KNOWN_GRAMS n-grams by code, in a table with open addressing, so that a look-up needs no sorting."""

    def __init__(self, codes: np.ndarray, scores: np.ndarray):
        self.codes, self.scores = codes[:KNOWN_GRAMS], scores[:KNOWN_GRAMS]
        self.bits = max(10, int(len(self.codes) * 4).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        left, at = np.arange(len(self.codes)), self._home(self.codes)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]  # of several that claim a slot the last one has it
            wait = self.slots[at] != left
            left, at = left[wait], (at[wait] + 1) & (len(self.slots) - 1)

    def _home(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Places of codes in the table, -1 where they aren't known."""
        out, left, at = np.full(len(codes), -1, np.int64), np.arange(len(codes)), self._home(codes)
        while len(left):
            row = self.slots[at]
            hit = (row >= 0) & (self.codes[np.maximum(row, 0)] == codes[left] if len(self.codes) else False)
            out[left[hit]] = row[hit]
            on = (row >= 0) & ~hit
            left, at = left[on], (at[on] + 1) & (len(self.slots) - 1)
        return out


class Profiles:
    """Language prototypes with the scores (products with the prototypes) of the n-grams met in training."""

    def __init__(self, prototypes: np.ndarray, codes: np.ndarray, scores: np.ndarray):
        self.prototypes, self.grams, self.letters = prototypes, Grams(codes, scores), {}

    def products(self, texts: list[str]) -> np.ndarray:
        """Product of each text's bundle of n-gram vectors with each prototype (zeros without n-grams).

        The product with a bundle is the sum of the products with its n-grams, so bundles are never made. The
        cosines of a text with the prototypes, which have length 1, are its products over the length of its
        bundle, which all of them share. N-grams not met before are scored once a batch and join the table while it has room.
        """
        codes, owner = gram_codes(texts)
        out = np.zeros((len(texts), len(self.prototypes)))
        if not len(codes):
            return out
        at = self.grams.find(codes)
        new = at < 0
        scores = self.grams.scores
        if new.any():
            own, place = np.unique(codes[new], return_inverse=True)
            fresh = np.concatenate([gram_vectors(own[k : k + 4096], self.prototypes.shape[1], self.letters).astype(np.float32) @ self.prototypes.T for k in range(0, len(own), 4096)])
            at[new] = len(scores) + place
            scores = np.concatenate([scores, fresh])
            if len(scores) <= KNOWN_GRAMS:
                self.grams = Grams(np.concatenate([self.grams.codes, own]), scores)
            if len(self.letters) > 10_000:
                self.letters = {}
        for part in self._by_size(owner, at):  # grams of each size lie one after the other by text
            begin = np.flatnonzero(np.diff(owner[part], prepend=-1))
            out[owner[part][begin]] += np.add.reduceat(scores[at[part]], begin, axis=0, dtype=np.float64)
        return out

    @staticmethod
    def _by_size(owner: np.ndarray, at: np.ndarray) -> list[slice]:
        ends = np.flatnonzero(np.diff(owner) < 0) + 1
        return [slice(a, b) for a, b in zip([0, *ends], [*ends, len(owner)])]


def fit(labelled: pd.DataFrame, dim: int = DIM, per_label: int = SEGMENTS_PER_LABEL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prototypes from (code, text), with the codes and scores of the n-grams met: bundles of the sentences of each
    label, less what all languages share.

    Labels may be wrong and texts mixed: after each round only sentences that their label's prototype wins are
    bundled again; at the end sentences still misjudged are added to their own prototype and taken from the other.
    A sentence's length is taken from its n-gram counts, as n-gram vectors are all but orthogonal.
    """
    none = np.zeros(0, np.int64)
    seen: dict[str, dict[str, int]] = {}
    for code, text in zip(labelled["code"], labelled["text"]):
        for s in sentences(text):
            per = seen.setdefault(s, {})
            per[code] = per.get(code, 0) + 1
    by: dict[str, list[str]] = {}
    for s, per in sorted(seen.items()):  # a sentence met more than once belongs to its most frequent label
        by.setdefault(max(sorted(per), key=per.get), []).append(s)
    segs, want, rng = [], [], np.random.default_rng(9)
    for k, code in enumerate(CODES):
        own = by.get(code, [])
        if len(own) > per_label:
            own = [own[i] for i in rng.choice(len(own), per_label, replace=False)]
        segs += own
        want += [k] * len(own)
    if not segs:
        return np.zeros((len(CODES), dim), np.float32), none, np.zeros((0, len(CODES)), np.float32)
    want_, known = np.array(want), {}
    codes, owner = gram_codes(segs)
    own, at = np.unique(codes, return_inverse=True)
    pair, n = np.unique(owner * len(own) + at, return_counts=True)
    who, gram = pair // len(own), pair % len(own)
    size = np.sqrt(np.maximum(np.bincount(who, weights=n.astype(float) ** 2, minlength=len(segs)), 1) * dim)
    share = n / size[who]
    vecs = gram_vectors(own, dim, known)
    begin = np.searchsorted(who, np.arange(len(segs)))
    blocks = [slice(k, k + 4096) for k in range(0, len(own), 4096)]

    def score(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        grams = np.concatenate([vecs[b].astype(np.float32) @ unit.T for b in blocks])
        return grams, np.add.reduceat(grams[gram] * share[:, None], begin, axis=0)

    keep, there = np.ones(len(segs), bool), np.bincount(want_, minlength=len(CODES)) > 0
    for _ in range(4):
        protos = np.zeros((len(CODES), dim))
        for k in np.flatnonzero(there):
            m = (keep & (want_ == k))[who]
            weight = np.bincount(gram[m], weights=share[m], minlength=len(own)).astype(np.float32) / max(1, (keep & (want_ == k)).sum())
            protos[k] = sum(weight[b] @ vecs[b].astype(np.float32) for b in blocks)
        shared = protos - protos[there].mean(0) * there[:, None]
        unit = shared / np.maximum(np.linalg.norm(shared, axis=1, keepdims=True), 1e-9)
        grams, found = score(unit)
        keep = found.argmax(1) == want_
    for _ in range(5):
        wrong = np.flatnonzero(keep & (found.argmax(1) != want_))
        if not len(wrong):
            break
        for i in wrong:
            part = slice(begin[i], begin[i + 1] if i + 1 < len(segs) else len(who))
            x = share[part] @ vecs[gram[part]].astype(np.float32)
            unit[want_[i]] += 0.05 * x
            unit[(unit @ x).argmax()] -= 0.05 * x
        unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)
        grams, found = score(unit)
    return unit.astype(np.float32), own, grams.astype(np.float32)


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang", sample_per_label: int = SAMPLE_PER_LABEL, dim: int = DIM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """fit() over a sample of about `sample_per_label` labelled documents a language (whole texts)."""
    known = docs.select(label_code(lang).alias("code"), F.col(text).alias("text")).where("code is not null and text is not null")
    n = {r["code"]: r["count"] for r in known.groupBy("code").count().collect()}
    if not n:
        return fit(pd.DataFrame({"code": [], "text": []}), dim)
    return fit(known.sampleBy("code", {k: min(1.0, sample_per_label / c) for k, c in n.items()}, seed=17).toPandas(), dim)


def judged(profiles: Profiles, d: pd.DataFrame, segments: bool) -> pd.DataFrame:
    """Rows of languages() for documents doc_id, label, text."""
    found = [sentences(t) if t else [] for t in d["text"]]
    whole = [k for k, f in enumerate(found) if not f]  # judged by all their letters
    flat = [s for f in found for s in f] + [letters(repaired(d["text"].iloc[k] or "")) for k in whole]
    row = np.concatenate([np.repeat(np.arange(len(d)), [len(f) for f in found]), np.array(whole, np.int64)])
    count = np.repeat([1, 0], [len(flat) - len(whole), len(whole)])
    product = profiles.products(flat)
    two = np.sort(product, axis=1)
    n_letters = np.array([len(s) - s.count(" ") for s in flat], np.int64)
    win = np.where((two[:, -1] > 0) & (n_letters > 0), product.argmax(1), -1)
    lead = np.where(win >= 0, np.clip((two[:, -1] - np.maximum(two[:, -2], 0)) / np.maximum(two[:, -1], 1e-9), 0, 1), 0)
    size = n_letters * (win >= 0)
    of = np.bincount(row * len(CODES) + np.maximum(win, 0), weights=size, minlength=len(d) * len(CODES)).reshape(-1, len(CODES)).argmax(1)[row]
    near = (win >= 0) & (product[np.arange(len(row)), of] >= (1 - UNSURE) * two[:, -1])
    win = np.where(near, of, win)
    use = np.flatnonzero((win >= 0) | (count == 0))  # a sentence that no prototype fits says nothing
    lost = np.setdiff1d(np.arange(len(d)), row[use])  # documents that have no other sentence
    row, win, lead, size, count = (np.concatenate([x[use], np.full(len(lost), y)]) for x, y in ((row, 0), (win, -1), (lead, 0.0), (size, 0), (count, 0)))
    row[len(use) :] = lost
    order = np.argsort(row * 16 + win + 1, kind="stable") if not segments else np.argsort(row, kind="stable")
    row, win, lead, size, count = (x[order] for x in (row, win, lead, size, count))
    begin = np.flatnonzero(np.diff(row * 16 + win + 1, prepend=-1))
    add = lambda x: np.add.reduceat(x, begin)
    pick, n = row[begin], np.diff([*begin, len(row)])
    total = np.bincount(row, weights=size, minlength=len(d))
    return pd.DataFrame({
        "doc_id": d["doc_id"].to_numpy()[pick], "label": d["label"].to_numpy()[pick], "segment": np.arange(len(pick)) - np.searchsorted(pick, pick),
        "lang": np.array([*CODES, None], object)[win[begin]], "sentences": add(count), "letters": add(size), "share": add(size) / np.maximum(total[pick], 1), "confidence": add(lead) / n,
    })


def languages(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_per_label: int = SAMPLE_PER_LABEL, dim: int = DIM, segments: bool = False) -> DataFrame:
    """The languages that each document contains in full sentences, with confidence; label: the code its label says.

    One row per document and language: doc_id, label, lang, sentences, share (of the document's sentence
    letters), confidence. With `segments`, one row per run of neighbouring sentences of one language instead:
    doc_id, label, segment (from 0), lang, sentences, letters, confidence.

    Each sentence's letters become permuted random vectors, bound into n-grams and bundled; the language is that
    of the prototype with the largest cosine, or that of most of the document where this one is less than UNSURE behind. Prototypes are fitted on a bounded sample of labelled documents
    and see every sentence of every text. confidence is the mean lead of the winning cosine over the second one,
    as a share of the winning one (0 to 1). A document without full sentences (statements, numbers, headings) has one row
    with 0 sentences, whose language is that of all its letters; lang is null and confidence 0 where it has none
    (null, empty and blank texts, numbers only). doc_id must be unique; an empty table gives no rows; other
    columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, text=text, lang=lang, sample_per_label=sample_per_label, dim=dim))

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        profiles = Profiles(*shared.value)
        for d in parts:
            at, chars = 0, 0
            for k, t in enumerate(d["text"]):
                chars += len(t or "")
                if chars >= PIECE_CHARS or k == len(d) - 1:
                    yield judged(profiles, d.iloc[at : k + 1], segments)
                    at, chars = k + 1, 0

    rows = spread(docs.select(F.col(doc_id).alias("doc_id"), label_code(lang).alias("label"), F.col(text).alias("text")), "doc_id")
    out = rows.mapInPandas(work, "doc_id long, label string, segment long, lang string, sentences long, letters long, share double, confidence double")
    return out.drop("share") if segments else out.drop("segment", "letters")
