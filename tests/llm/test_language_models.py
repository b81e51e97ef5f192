"""Scores and rules that count n-grams, against plain counting."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import lm_scoring, perplexity_rules
from faultline.llm.common import table
from tests.llm import brute

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "One"), (4, "One"), (5, "one two"), (6, "a b c a b c a b c"), (7, "ü" * 5000 + " " + "x " * 3000),
       (None, "a b c"), (8, "line one\nline one\n\nline one | # <>"), (9, "\x85 a b")]


def stupid_backoff(rows, order=3):
    seqs = [brute.words(t) for _, t in rows]
    n = Counter(tuple(w[i:i + k]) for w in seqs for k in range(1, order + 1) for i in range(len(w) - k + 1))
    total, out = sum(map(len, seqs)), []
    for (i, _), w in zip(rows, seqs, strict=True):
        s = 0.0
        for at in range(len(w)):
            missed = 0
            for k in range(min(order, at + 1), 0, -1):
                g = tuple(w[at - k + 1:at + 1])
                if k == 1 or n[g] >= 2:
                    s += missed * math.log(0.4) + math.log(n[g] / (n[g[:-1]] if k > 1 else total))
                    break
                missed += 1
        out.append((str(i), len(w), round(s, 5)))
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [200, 1 << 20])
def test_backoff_scores(docs_of, block_bytes):
    got = lm_scoring.document_scores(docs_of(ODD), block_bytes=block_bytes).collect()
    assert sorted((str(r.doc_id), r.n_words, round(r.log_score, 5)) for r in got) == stupid_backoff(ODD)
    assert all((r.mean_log_score is None) == (r.n_words == 0) for r in got)


def test_backoff_of_nothing(docs_of):
    assert lm_scoring.document_scores(docs_of([])).collect() == []


def test_packed_keys():
    for keys in ([5], [0, 2**64 - 1], list(range(0, 2000, 7)), []):
        k = np.array(keys, np.uint64)
        assert (lm_scoring._unpacked(lm_scoring._packed(k)) == k).all()
    for texts in ([], [b""], [b"a", b"", b"\n\x00" * 999]):
        assert lm_scoring._parted(lm_scoring._joined(texts)) == texts


def test_counted_rules(docs_of):
    got = perplexity_rules.quality_rules(docs_of(ODD)).collect()
    assert len(got) == len(ODD)
    want = sorted((str(i), *brute.quality_figures(t).values()) for i, t in ODD)
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) for r in got)
    assert perplexity_rules.quality_rules(docs_of([])).collect() == []


def test_probabilities_add_up(spark):
    docs = table(spark, SF, "documents").where("lang = 'es'")
    model = perplexity_rules.kneser_ney(docs)
    arrays = perplexity_rules.Arrays(perplexity_rules.sorted_arrays(model).collect())
    symbols = arrays.at["es", 1, "p"][0]
    for context in ("   ", "de ", "zqz"):
        base = perplexity_rules.ngrams([context])[0][-1]
        keys = (base << np.uint64(16)) | symbols
        unseen = math.exp(arrays.score("es", (base << np.uint64(16)) | np.array([0xFFFE], np.uint64))[0])
        assert abs(np.exp(arrays.score("es", keys).astype(float)).sum() + unseen - 1) < 1e-3


def test_broadcast_and_joined_scores_agree(spark):
    docs = table(spark, SF, "documents")
    model = perplexity_rules.kneser_ney(docs.where("doc_id % 2 = 0"))  # half of the n-grams are unknown to it
    a = {r.doc_id: r for r in perplexity_rules.scores(docs, model).collect()}
    b = {r.doc_id: r for r in perplexity_rules.scores(docs, model, model_rows=10).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k].n_words == b[k].n_words and abs(a[k].log_perplexity - b[k].log_perplexity) < 1e-3


def test_bands_keep_clean_documents(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    found = perplexity_rules.quality_rules(docs).join(labels, "doc_id").where("NOT base_failed").groupBy("quality").agg(
        F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in found}
    assert kept[1] >= 0.98 and kept[0] <= 0.9
