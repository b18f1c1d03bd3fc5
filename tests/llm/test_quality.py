import random
import re
from collections import Counter


from tablewise.llm import quality

from .conftest import rows_of_documents

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    words = re.findall(WORD, text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines))}

    def inside(k):
        seen = Counter(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
        return {j for i in range(len(words) - k + 1) if seen[tuple(words[i:i + k])] > 1 for j in range(i, i + k)}

    out["n_repeat_words"] = len(inside(8))
    out["base_failed"] = len(words) < 20 or 100 * out["n_repeat_words"] > 30 * len(words)
    kept = not out["base_failed"]
    for k, limit in quality.GRAM_LIMITS.items():
        out[f"gram_chars_{k}"] = sum(len(words[j]) for j in inside(k))
        kept = kept and out[f"gram_chars_{k}"] <= limit * out["word_chars"]
    seen, n = set(), 0
    for x in lines:
        if x in seen:
            n += sum(map(len, re.findall(WORD, x)))
        seen.add(x)
    out["dup_line_chars"] = n
    out["kept"] = kept and n <= quality.LINE_LIMIT * out["word_chars"]
    return out


def test_figures(docs, no_docs):
    got = quality.judge(docs)
    names = [c for c in got.columns if c != "doc_id"]
    want = Counter((r[0], *[brute(r[1])[c] for c in names]) for r in rows_of_documents())
    assert Counter(map(tuple, got.select("doc_id", *names).collect())) == want
    assert quality.judge(no_docs).count() == 0


def test_random_texts_and_kept_rows(spark):
    rnd = random.Random(2)
    rows = [(i, "".join(rnd.choice(["a", "b", "ç", " ", " ", "\n", "\t", "|"]) for _ in range(rnd.randint(0, 400)))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = quality.judge(df).collect()
    for r in got:
        assert {k: v for k, v in r.asDict().items() if k != "doc_id"} == brute(rows[r.doc_id][1])
    kept = quality.judge(df, keep_rows=True)
    assert kept.columns == ["doc_id", "text", "kept"] and {tuple(r)[:2] for r in kept.collect()} == set(rows)


def test_each_rule_rejects_alone(spark):
    """Words are of one length, so shares of words are shares of characters."""
    def fresh(tag, n):
        return [f"{tag}{i:04d}" for i in range(n)]

    def phrase_twice(k, n):
        phrase, rest = fresh("p", k), fresh("w", n - 2 * k)
        return " ".join(phrase + rest[:7] + phrase + rest[7:])

    sizes = {5: 60, 6: 83, 7: 104, 8: 128, 9: 157, 10: 190}
    texts = {k: phrase_twice(k, n) for k, n in sizes.items()}
    line, rest = " ".join(fresh("p", 4)), fresh("w", 24)
    texts["line"] = "\n".join([line, *rest[:9], line, *rest[9:], line])
    clean = {f"clean{k}": phrase_twice(k, 4 * n) for k, n in sizes.items()} | {"fresh": " ".join(fresh("w", 200)), "line once": "\n".join([line, *fresh("w", 24)])}
    rows = list((texts | clean).items())
    got = quality.judge(spark.createDataFrame([(i, x) for i, (_, x) in enumerate(rows)], "doc_id long, text string")).collect()
    for r in got:
        name = rows[r.doc_id][0]
        over = {k for k, limit in quality.GRAM_LIMITS.items() if r[f"gram_chars_{k}"] > limit * r.word_chars}
        over |= {"line"} if r.dup_line_chars > quality.LINE_LIMIT * r.word_chars else set()
        assert not r.base_failed, name
        assert (over, r.kept) == (({name}, False) if name in texts else (set(), True)), name
