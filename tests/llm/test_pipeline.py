"""Quality rules and the pipeline against plain versions."""

import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from quotelens.llm import quality
from tests.llm.conftest import ROWS, SENTENCE


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    again = [x for i, x in enumerate(lines) if x in lines[:i]]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    repeat = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 3)}
    dup = []
    for n in quality.MAX_NGRAM_SHARE:
        grams, seen, inside = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)], set(), set()
        for i, g in enumerate(grams):
            if g in seen:
                inside.update(range(i, i + n))
            seen.add(g)
        dup.append(sum(len(words[i]) for i in inside))
    total = sum(map(len, words))
    out = [len(words), total, len(re.findall(r"[#*$%&|<>]", text or "")), len(again), len(repeat), *dup, sum(map(len, again))]
    failed = len(words) < 50 or 100 * len(repeat) > 50 * len(words)
    bad = any(d > limit * total for d, limit in zip(dup, quality.MAX_NGRAM_SHARE.values(), strict=True)) or bool(lines) and (len(again) > 0.3 * len(lines) or out[-1] > 0.3 * len(text))
    return out, failed, not failed and not bad


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb", "é", "\n", " ", "ccc\n", "d　d", "#", "<|", "a b c d e f g h i j k l", "\x0b", "\x85"]), max_size=60).map(" ".join))
def test_measures_equal_plain_loops(text):
    assert quality.measure(text) == plain_measures(text)


def test_measures_of_rows(docs, empty):
    got = quality.judge(docs).collect()
    assert Counter((r.doc_id, *(r[m] for m in quality.MEASURES), r.base_failed, r.kept) for r in got) == Counter((d, *plain_measures(t)[0], *plain_measures(t)[1:]) for d, t in ROWS if True)
    assert quality.judge(empty).count() == 0


def test_one_repeated_sentence_is_no_reason():
    text = " ".join(f"w{i}" for i in range(90))
    assert quality.measure(text + " " + SENTENCE + "\n" + text[:30])[2]
    assert not quality.measure("\n".join(["the same line of words again"] * 40))[2]


LONG = [" ".join(f"d{k}n{i}" for i in range(120)) for k in range(6)]
PASSAGE = " ".join(f"shared{i}" for i in range(60))


def corpus(spark):
    rows = [
        (1, LONG[0], "a"), (2, LONG[0].replace(" ", "  "), "b"), (3, LONG[0] + " ", "c"),  # copies but for white space: the longest stays
        (4, LONG[1], "a"), (5, LONG[1].replace("d1n60", "edit"), "a"),  # near copies
        (6, LONG[2] + " " + PASSAGE, "a"), (7, PASSAGE + " " + LONG[3], "a"),  # a shared passage
        (8, "too short", "a"), (9, None, "a"), (10, "", None), (11, "again and again " * 60, "a"), (12, LONG[4], "a"), (12, LONG[4], "a"), (12, LONG[5], "a"), (None, "null " + LONG[5], None),
    ]
    return spark.createDataFrame([(d, t, "en", s, len(t or ""), 1, True, "x") for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, key long, kept boolean, left string")


def test_stages(spark):
    docs = corpus(spark)
    names, sizes = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == names
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        sizes[name] = sorted((r.doc_id if r.doc_id is not None else -1) for r in docs.collect())
    assert sizes["quality_rules"] == [-1, 1, 2, 3, 4, 5, 6, 7, 12, 12, 12]
    assert sizes["exact_dedup"] == [-1, 2, 4, 5, 6, 7, 12, 12]
    assert sizes["near_dedup"] == [2, 4, 6, 7, 12, 12]  # the null id's text is a near copy of document 12's
    assert sizes["substring_dedup"] == [2, 4, 6, 7, 12, 12]
    texts = {r.doc_id: r for r in docs.collect()}
    assert texts[7].text == LONG[3] and texts[7].n_chars == len(LONG[3]) and texts[6].text == LONG[2] + " " + PASSAGE
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert sorted(r.doc_id for r in packed) == [2, 4, 6, 7, 12, 12] and len({r.sequence_id for r in packed}) <= 2


def test_run_and_empty_table(spark, tmp_path):
    docs = corpus(spark)
    docs.write.parquet(f"{tmp_path}/full/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/full").count() == 6
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
