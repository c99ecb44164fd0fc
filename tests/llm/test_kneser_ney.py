"""Language models against an interpolated Kneser-Ney written down from its formula, with nothing packed or sorted."""

import math
import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tarnwheel.llm import langid, queries

FOLDER = "/root/testdata/sf0.001"
BLANK, DISCOUNT, ORDER = "_", 0.75, 4


def symbols(text):
    """Letters in lower case; whatever lies between them, and the end, is one blank."""
    out = []
    for c in text + "\n":
        if c.isalpha():
            low = c.lower()
            out.append(low if len(low) == 1 else c)
        elif ord(c) > 127 and unicodedata.category(c)[0] == "M":
            out.append(c)
        elif out and out[-1] != BLANK:
            out.append(BLANK)
    return out


def grams(text):
    line = [BLANK] * (ORDER - 1) + symbols(text)
    return [tuple(line[i : i + ORDER]) for i in range(len(line) - ORDER + 1)]


class KneserNey:
    def __init__(self, texts):
        counts = [None] * (ORDER + 1)
        counts[ORDER] = Counter(g for t in texts for g in grams(t))
        for order in range(ORDER - 1, 0, -1):
            # in how many distinct contexts a shorter one goes on
            counts[order] = Counter(g[1:] for g in counts[order + 1])
        self.counts, self.unseen = counts, None
        self.totals, self.kinds = [None] * (ORDER + 1), [None] * (ORDER + 1)
        for order in range(1, ORDER + 1):
            self.totals[order], self.kinds[order] = defaultdict(int), defaultdict(int)
            for g, n in counts[order].items():
                self.totals[order][g[:-1]] += n
                self.kinds[order][g[:-1]] += 1
        self.memo = {}

    def probability(self, gram):
        if not gram:
            return self.unseen
        if gram not in self.memo:
            order, context = len(gram), gram[:-1]
            total, lower = self.totals[order].get(context, 0), self.probability(gram[1:])
            if total:
                lower *= DISCOUNT * self.kinds[order][context] / total
                lower += max(self.counts[order].get(gram, 0) - DISCOUNT, 0) / total
            self.memo[gram] = lower
        return self.memo[gram]

    def mean_loss(self, text):
        found = grams(text)
        return sum(-math.log(self.probability(g)) for g in found) / max(len(found), 1)


def models(texts_by_lang):
    found = {lang: KneserNey(texts) for lang, texts in sorted(texts_by_lang.items())}
    every = {g for m in found.values() for g in m.counts[1]}
    for m in found.values():
        m.unseen = 1 / (len(every) + 1)
    return found


def fitted(texts_by_lang):
    own = {}
    for lang, texts in texts_by_lang.items():
        packed = []
        for text in texts:
            codes, piece_of, _, _ = langid.encoded([text])
            packed.append(langid.packed(codes)[piece_of >= 0])
        own[lang] = np.unique(np.concatenate(packed), return_counts=True)
    return langid.fit(own)


def test_losses_of_any_texts():
    rng = random.Random(12)
    alphabets = {"x": "abc ", "y": "bcdé .", "z": "αβγ ́!"}
    texts = {k: ["".join(rng.choice(a) for _ in range(rng.randrange(60))) for _ in range(12)] + ["A"] for k, a in alphabets.items()}
    brute, model = models(texts), fitted(texts)
    asked = ["", "!!", "a", "abcabc", "ABC dÉ", "zzz qqq", "  b  b  ", "αβ á"]
    asked += ["".join(rng.choice("abcdé αβ́.x") for _ in range(rng.randrange(80))) for _ in range(60)]
    means, _ = langid.mean_losses(model, asked)
    assert model.langs == list(brute)
    for text, found in zip(asked, means):
        assert found == pytest.approx([m.mean_loss(text) for m in brute.values()], abs=1e-5)


def test_query(spark):
    """Every prediction at the smallest size, where all documents that are not held out are learned from."""
    rows = duckdb.sql(f"SELECT doc_id, text, lang FROM '{FOLDER}/documents.parquet'").fetchall()
    learned = defaultdict(list)
    for doc_id, text, lang in rows:
        if text is not None and lang is not None and zlib.crc32(str(doc_id).encode()) % 3 != 1:
            learned[lang].append(text)
    assert max(map(len, learned.values())) <= langid.TRAINING_DOCS
    brute = models(learned)
    found = {r["doc_id"]: r for r in queries.QUERIES["op4_language_id"](spark, FOLDER).collect()}
    for doc_id, text, _ in rows:
        losses = {lang: m.mean_loss(text) for lang, m in brute.items()}
        best, letters = min(losses.values()), sum(c != BLANK for c in symbols(text))
        wanted = min(losses, key=losses.get) if letters else "und"
        score = 1 / sum(math.exp(-(x - best) * min(letters, langid.SCORE_LETTERS)) for x in losses.values()) if letters else 0.0
        assert found[doc_id]["lang_pred"] == wanted
        assert found[doc_id]["score"] == pytest.approx(score, abs=2e-3)
