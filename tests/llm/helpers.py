"""Small tables with awkward rows, shared by the operators' tests."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def prose(draw, n):
    return " ".join(draw.choice("abcdefgh") + "".join(draw.choice("aeioustn") for _ in range(draw.randint(1, 6))) for _ in range(n))


def awkward_docs(spark, seed=3):
    """(doc_id, text, lang, source, n_chars, key, words): nulls, empty and long texts, copies, and names that could clash."""
    draw = random.Random(seed)
    base = [prose(draw, draw.randint(1, 120)) for _ in range(12)]
    texts = base + [base[3], base[3], base[4].replace("a", "A", 3), base[5] + " one more word", None, "", " \t\n ", "one", "two\n\ntwo\ntwo"]
    shared = prose(draw, 40)
    texts += [f"{prose(draw, 15)} {shared} {prose(draw, 9)}", f"{shared}\n{prose(draw, 30)}", prose(draw, 30) * 2]
    texts += ["é" * 40 + " \U0001f600 <|end|> \\", prose(draw, 6000), ("spam ham eggs tea jam " * 30).strip(), "<|endoftext|> don't we'll 12³ x"]
    rows = [(i, t, "en" if i % 2 else None, f"host{i % 3}" if i % 5 else None, None if t is None else len(t), "k", "w") for i, t in enumerate(texts)]
    rows += [rows[2], (None, base[6], "en", "host1", 5, "k", "w")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, words string")


def none_of(df):
    return df.limit(0)
