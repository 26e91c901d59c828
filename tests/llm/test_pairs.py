import re
import sys
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quillmill.llm.crf import ChainCRF
from quillmill.llm.pairs import COUNTED, PairTagger, Vocabulary, clauses, defective_pairs, language, said, word_lists
from tests.conftest import DATA

SCHEMA = "output_id long, question string, answer string, error string"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    crf = ChainCRF(6, 3)
    crf.emit, crf.move = rng.standard_normal((6, 3)), rng.standard_normal((3, 3))
    seq = [[0, 1], [2], [3, 5], [4]]
    s = crf.scores(seq)
    paths = [(a, b, c, d) for a in range(3) for b in range(3) for c in range(3) for d in range(3)]
    score = np.array([sum(s[t, p[t]] for t in range(4)) + sum(crf.move[x, y] for x, y in zip(p, p[1:])) for p in paths])
    prob = np.exp(score - score.max())
    prob /= prob.sum()
    want = np.array([[prob[[p[t] == k for p in paths]].sum() for k in range(3)] for t in range(4)])
    assert np.allclose(crf.marginals(s)[0], want)
    assert crf.decode(seq) == list(paths[int(prob.argmax())])


def test_parts():
    assert said("<think>x. y</think>\n\n**Answer:** ") == "" and said("—") == "" and said("N/A") == "" and said("﻿") == "" and said(None) == ""
    assert said("1279") == "1279" and said("Answer: in 1279") == "in 1279"
    assert len(clauses("One. Two at St. Anne. [Data: Entities (3, 4)]")) == 2
    assert language("Khi nao thi Nam ung ho vua?") == "vi" and language("When did it end?") == "en" and language("12") is None


QUESTION_EN = "Who ordered the palace of Zefler Nuxhib?"
QUESTION_VI = "Ai đã ra lệnh cung điện của Zefler Nuxhib?"
CASES = [
    (QUESTION_EN, None, "empty"),
    (QUESTION_EN, "<think>hm, who was it?</think>\n", "empty"),
    (QUESTION_EN, "...", "empty"),
    (QUESTION_EN, "1279", None),
    (QUESTION_EN, "**Pâdgli Dylquo** (946–993)", None),
    (QUESTION_EN, "I'm sorry, but the provided data does not mention Zefler Nuxhib. Please consult another source.", "refusal"),
    (QUESTION_VI, "Rất tiếc, tôi không tìm thấy câu trả lời trong tài liệu.", "refusal"),
    (QUESTION_EN, "Zefler Nuxhib refused the crown, saying “I cannot answer for it”, and went home to Pavtac.", None),
    (QUESTION_EN, "The annals do not mention a mother, yet they state that Zefler Nuxhib was born in Pavtac.", None),
    (QUESTION_EN, "Sorry for the fallen, Zefler Nuxhib built a shrine at Pavtac.", None),
    (QUESTION_EN, "who ordered the palace of zefler nuxhib", "copied_question"),
    (QUESTION_EN, "Question: " + QUESTION_EN, "copied_question"),
    (QUESTION_EN, QUESTION_EN + " " + QUESTION_EN, "copied_question"),
    (QUESTION_EN, QUESTION_EN + " The king of Pavtac ordered the palace before the harvest.", None),
    (QUESTION_VI, "Ai da ra lenh cung dien cua Zefler Nuxhib?", "copied_question"),
    (QUESTION_EN, "The king of Pavtac ordered the palace before the harvest, led by the", "truncated"),
    (QUESTION_VI, "Vua của Pavtac ra lệnh cung điện trước mùa màng và", "truncated"),
    (QUESTION_EN, "The king of Pavtac ordered the palace, owing to the harvest between the general and the", "truncated"),
    (QUESTION_EN, "The king of Pavtac ordered the palace before the harvest of the...", "truncated"),
    (QUESTION_EN, "The king of Pavtac ordered the palace, although the king of that was…", "truncated"),
    (QUESTION_EN, "“Vua của Pavtac ra lệnh cung điện trước mùa màng và sau khi họ đến.”", "other_language"),
    (QUESTION_EN, "." * 100 + " N/A", "empty"),
    (QUESTION_EN, "La canción fue escrita por Zefler Nuxhib y publicada con Pavtac Mopli.", "other_language"),
    (QUESTION_EN, "这首歌由Zefler Nuxhib演唱，收录在第二张专辑中。", "other_language"),
    (QUESTION_VI, "The palace was ordered by the king of Pavtac before the harvest of 1279.", "other_language"),
    (QUESTION_EN, "The palace was ordered in Pavtac. In the original: “Zefler Nuxhib có trống nổi tiếng của làng”.", None),
]


def test_cases(spark):
    base = spark.read.parquet(f"{DATA}/raw_outputs.parquet").select("output_id", "question", "answer", "error")
    own = spark.createDataFrame([(10_000_000 + i, q, a, None) for i, (q, a, _) in enumerate(CASES)], SCHEMA)
    got = {r.output_id: r.defect for r in defective_pairs(base.unionByName(own), sample_rows=10_000).filter("output_id >= 10000000").collect()}
    wrong = [(c, got.get(10_000_000 + i)) for i, c in enumerate(CASES) if got.get(10_000_000 + i) != c[2]]
    assert not wrong


def test_dirt(spark):
    rows = [(1, None, None, None), (2, "What?", "", " "), (3, "What?", "x", "timeout"), (None, "What?", "", None), (2, "What?", "", " "), (4, "What is it?", "It is a very good thing. " * 3000, None)]
    got = defective_pairs(spark.createDataFrame(rows, SCHEMA).withColumn("i", F.lit(0)).withColumn("defect", F.lit("clash"))).collect()
    assert sorted((r.output_id, r.defect) for r in got) == [(1, "empty"), (2, "empty")]
    assert defective_pairs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_words_are_counted_over_all_runs(spark):
    base = spark.read.parquet(f"{DATA}/raw_outputs.parquet").select("output_id", "question", "answer", "error")
    rare = [a + b for a in "brel drun flon grim plos snav trul vosk welt yarn".split() for b in "aber edge iker olim unda ane ist orn ulle ety".split()]
    rows = [(20_000_000 + i, QUESTION_EN, f"The king said that {' '.join(rare[(10 * i + 7 * k) % 100] for k in range(10))} had come.", None) for i in range(60)]
    whole = [(30_000_000 + i, QUESTION_EN, "Bramkro " + " ".join(rare[10 * i : 10 * i + 9]) + ".", None) for i in range(10)]
    cut = [(40_000_000 + i, QUESTION_EN, f"Pavtac: {w}", None) for i, w in enumerate(rare[:10])]
    got = defective_pairs(base.unionByName(spark.createDataFrame(rows + whole + cut, SCHEMA)), sample_rows=500).filter("output_id >= 20000000").collect()
    assert not got


def test_sequences_decoded_together_equal_enumeration():
    rng = np.random.default_rng(3)
    crf = ChainCRF(9, 3)
    crf.emit, crf.move = rng.standard_normal((9, 3)), rng.standard_normal((3, 3))
    seqs = [[sorted({0, *map(int, rng.integers(1, 9, 4))}) for _ in range(n)] for n in [2, 0, 5, 1, 3, 5, 0, 1, 4, 2]]
    for seq, got in zip(seqs, crf.decode_all(seqs), strict=True):
        score = lambda p: sum(crf.emit[f, k].sum() for f, k in zip(seq, p)) + sum(crf.move[a, b] for a, b in zip(p, p[1:]))  # noqa: E731, B023
        assert tuple(got) == max(product(range(3), repeat=len(seq)), key=score)
    assert crf.decode_all([]) == [] and crf.decode_all([[]]) == [[]]


def _passes(work) -> int:
    """Calls of compiled patterns, each a pass over a text, and decodings."""
    found = 0

    def count(frame, event, arg):
        nonlocal found
        found += (event == "c_call" and isinstance(getattr(arg, "__self__", None), re.Pattern)) or (event == "call" and frame.f_code is ChainCRF.scores.__code__)

    sys.setprofile(count)
    try:
        work()
    finally:
        sys.setprofile(None)
    return found


def test_a_pair_takes_few_passes(spark):
    rows = spark.read.parquet(f"{DATA}/raw_outputs.parquet").filter("error is null and question is not null").select("question", "answer").orderBy("output_id").limit(200).collect()
    tagger = PairTagger(rows, Vocabulary(pd.DataFrame({"word": ["the"], **{k: [1] for k in COUNTED}}), {k: 1.0 for k in COUNTED}))
    got = []
    assert _passes(lambda: got.extend(tagger.defects(rows))) <= 22 * len(rows)
    assert got == [d for r in rows for d in tagger.defects([r])]
    assert list(tagger.defects(rows, at_once=7)) == got
    assert _passes(lambda: word_lists(rows)) <= 10 * len(rows)


def test_clauses_keep_stops_and_abbreviations():
    assert clauses("He left.) Then St. Anne\nvol. 3 came… “Yes?” no") == ["He left.", "Then St. Anne", "vol. 3 came…", "“Yes?", "no"]
    assert clauses("One.\n\nTwo \n three.four! ") == ["One.", "Two", "three.four!"]
