"""Every rule of the default table alone decides about some text."""

import pytest

from strandloom.llm import quality_rules as Q

PLAIN = [chr(97 + i % 26) + chr(97 + i // 26) + "ord" for i in range(60)]
PROSE = ["the" if i % 10 == 0 else w for i, w in enumerate(PLAIN)]


def lines(words, before="", after=""):
    return "\n".join(before + " ".join(words[i : i + 10]) + after for i in range(0, len(words), 10))


CASES = {
    "mean_word_length": lines([w if w == "the" else w * 6 for w in PROSE]),
    "symbols_per_word": lines([w + "#" * (i % 2) for i, w in enumerate(PROSE)]),
    "stop_words_per_word": lines(PLAIN),
    "digits_per_character": lines([w if w == "the" else f"{w[:2]}{1000 + i}" for i, w in enumerate(PROSE)]),
    "duplicate_lines": " ".join(PROSE) + "\ntail" * 5,
    "bullet_lines": lines(PROSE, before="\t• "),
    "ellipsis_lines": lines(PROSE, after=" …\r"),
}


def test_every_rule_has_a_case():
    assert {r.name for r in Q.RULES} == set(CASES)


@pytest.mark.parametrize("name", sorted(CASES))
def test_rule_alone_decides(spark, name):
    docs = spark.createDataFrame([(1, lines(PROSE)), (2, CASES[name])], "doc_id long, text string")
    kept = lambda rules: {r.doc_id: r.kept for r in Q.judge(docs, rules).collect()}
    assert kept(Q.RULES) == {1: True, 2: False}
    assert kept([r for r in Q.RULES if r.name != name]) == {1: True, 2: True}
