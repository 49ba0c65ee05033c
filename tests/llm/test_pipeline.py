"""The pipeline's stages, one after the other, on odd rows and on a small table."""

from collections import Counter

import corpus_pipeline as pipeline
import __spark_entry__ as entry
from boxloom.llm import langid
from tests.llm.cases import components, frame, odd_documents, prose
from tests.llm.test_copies import grams, lowered, overlap
from tests.llm.test_texts import decontaminate_words


def test_registered():
    found = entry.queries()
    assert "pipeline" in found and all(any(k.startswith(f"op{n}_") for k in found) for n in range(1, 14))
    assert len(pipeline.STAGES) == 5


def test_stages_keep_columns(spark, folder):
    docs = frame(spark, odd_documents())
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert name == "packing" or docs.columns == pipeline.COLUMNS
    assert docs.count() > 0
    empty = frame(spark, odd_documents()).limit(0)
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, folder)
    assert empty.count() == 0


def test_texts_of_one_id(spark, folder):
    """A copy or a leak under an id takes no other text of that id with it."""
    item = next(r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if len(r["text"].split()) > 20)
    base = prose(1, 130).split()
    texts = {"copy": " ".join(base), "near": " ".join([*base[:60], "other", *base[61:]]), "lone": prose(2, 90), "leak": f"{prose(3, 30)} {item}"}
    docs = frame(spark, [(1, texts["near"]), (1, texts["lone"]), (2, texts["copy"]), (3, texts["leak"]), (3, prose(5, 80)), (4, prose(6, 80))])
    left = pipeline.near(spark, docs, folder).collect()
    assert Counter(r["doc_id"] for r in left) in (Counter([1, 1, 3, 3, 4]), Counter([1, 2, 3, 3, 4]))
    assert texts["lone"] in {r["text"] for r in left}
    left = {(r["doc_id"], r["text"]) for r in pipeline.decontaminated(spark, docs, folder).collect()}
    assert left == {(r["doc_id"], r["text"]) for r in docs.collect()} - {(3, texts["leak"])}


def test_plain_version(spark, folder):
    """Every stage against a plain version on its own input."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    scores = {r["id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, langid.learn(docs)).collect()}
    kept = pipeline.language(spark, docs, folder)
    left = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert set(left) == {i for i, (lang, score) in scores.items() if lang != "und" and score >= pipeline.LEAST_SCORE}
    assert len(left) >= 0.97 * len(rows)
    kept = pipeline.exact(spark, kept, folder)
    groups = {}
    for i, t in left.items():
        groups.setdefault(lowered(t), []).append(i)
    left = {max(g): left[max(g)] for g in groups.values()}
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(list(left))
    kept = pipeline.near(spark, kept, folder)
    sets = {i: grams(t) for i, t in left.items()}
    labels = components(sorted(sets), lambda a, b: bool(sets[a]) and overlap(sets[a], sets[b]) >= 0.8)
    left = {i: t for i, t in left.items() if labels[i] == i}
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(list(left))
    kept = pipeline.decontaminated(spark, kept, folder)
    items = [decontaminate_words(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    whole = [" ".join(w) for w in items if len(w) >= 8]
    runs = {tuple(w[k : k + 8]) for w in items for k in range(len(w) - 7)}
    got = {r["doc_id"] for r in kept.collect()}
    for i, t in left.items():
        words = decontaminate_words(t)
        if any(f" {x} " in f" {' '.join(words)} " for x in whole):
            assert i not in got
        elif not any(tuple(words[k : k + 8]) in runs for k in range(len(words) - 7)):
            assert i in got
    pieces = pipeline.packed(spark, kept, folder).collect()
    assert {r["doc_id"] for r in pieces} == got
