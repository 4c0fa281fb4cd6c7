"""Quality measures against a plain reading, and thresholds that follow each group."""

import re
from collections import Counter

from kinfold.llm import quality as Q
from tests.llm.oracle import same_as_sql

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_words string, _low string"


def brute(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    found = Counter(windows)
    covered = {j for i, w in enumerate(windows) if found[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)), len(covered),
    )


TEXTS = [
    None, "", " \n\t", "a b c d e", "a b c d e a b c d e", "a a a a a a a", "x y\nx y\n\nx y\n #$% é",
    "a b c d e f a b c d e g h i j k l m n o p q r s t", "one two " * 3000, "é 東京 a|b <c>\r\nline\r\nline",
    " ".join(f"w{i}" for i in range(40)) + " tail " + " ".join(f"w{i}" for i in range(10, 17)),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, la, s, "clash", "clash") for i, (t, la, s) in enumerate(rows)], SCHEMA)


def test_measures(spark):
    docs = frame(spark, [(t, None, None) for t in TEXTS])
    rows = {r.doc_id: r for r in Q.judge(docs).collect()}
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(text), text
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_thresholds_follow_the_group(spark):
    """Code with many symbols is usual in one source and an outlier in another."""
    plain = [(" ".join(f"word{i}x{j}" for j in range(30)), "en", "prose") for i in range(60)]
    code = [(" ".join(f"a{i}x{j} <|>" for j in range(30)), "en", "code") for i in range(60)]
    odd = [code[0], ("# " * 5 + " ".join(f"v{j}" for j in range(30)), None, None)]
    rows = Q.judge(frame(spark, plain + code + [(odd[0][0] + " z", "en", "prose"), odd[1]])).collect()
    kept = {r.doc_id: r.kept for r in rows}
    assert all(kept[i] for i in range(120))
    assert not kept[120]
    assert kept[121]  # alone in its group of nulls


def test_native_plan_empty_table_and_repeats(spark):
    assert Q.judge(frame(spark, [])).count() == 0
    docs = frame(spark, [(" ".join(f"w{j}" for j in range(20)), "en", "s")] * 3)
    plan = Q.judge(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert sorted(Q.keep_good(docs).columns) == sorted(docs.columns)
    assert Q.keep_good(docs).count() == 3


def test_query(spark, sf_small):
    assert same_as_sql(spark, "op9_quality_rules", sf_small) > 0
