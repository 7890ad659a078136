import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessergraph.llm import chat, embeddings, html
from tessergraph.llm.common import components
from tests.llm.helpers import none_of
from tests.llm.test_text_operators import brute_components


def test_components(spark):
    draw = random.Random(3)
    edges = [(draw.randint(0, 400), draw.randint(0, 400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == brute_components(edges, {x for e in edges for x in e}) | {} if nodes == set(got) else {n: c for n, c in brute_components(edges, {x for e in edges for x in e}).items() if n in nodes} == got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embeddings(spark):
    draw = np.random.default_rng(6)
    base = draw.normal(size=(300, 16))
    near = base[:60] + draw.normal(scale=0.06, size=(60, 16))
    chain = np.array([np.r_[np.cos(0.25 * k), np.sin(0.25 * k), np.zeros(14)] for k in range(8)])
    vectors = np.vstack([base, near, base[:5], base[:20] * 3, chain]).astype(np.float32)
    rows = [(i, [float(x) for x in v], "x") for i, v in enumerate(vectors)]
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [None] + [1.0] * 15, [1.0] * 3]
    rows += [(1000 + i, v, "x") for i, v in enumerate(odd)] + [(1100 + i, v, "x") for i, v in enumerate(odd)] + [(None, rows[0][1], "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node string")
    got = {r.vec_id: r for r in embeddings.near_duplicates(table, margin=0.3123).collect()}
    unit = vectors.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    tied = unit @ unit.T >= 0.95
    np.fill_diagonal(tied, False)
    want = brute_components([(int(a), int(b)) for a, b in zip(*np.nonzero(tied))], range(len(vectors)))
    for i in range(len(vectors)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (tied[i].sum(), want[i], want[i] == i)
    for i in [*range(1000, 1006), *range(1100, 1106)]:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in (1006, 1106)] == [(1, 1006, True), (1, 1006, False)]  # another length
    assert len(got) == len(rows)
    assert embeddings.near_duplicates(none_of(table)).count() == 0


def test_hot_cell_in_blocks(spark, monkeypatch):
    draw = np.random.default_rng(9)
    monkeypatch.setattr(embeddings, "BLOCK", 40)
    v = draw.normal(size=12) + draw.normal(scale=0.02, size=(150, 12))
    table = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<float>")
    got = embeddings.near_duplicates(table).collect()
    assert all((r.n_links, r.component_id) == (149, 0) for r in got) and len(got) == 150


def test_recall_over_brute_force(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet")
    got = embeddings.near_duplicates(table, limit=0.3, margin=embeddings.MARGIN)
    v = np.array([r.embedding for r in table.orderBy("vec_id").collect()], np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    assert got.agg(F.sum("n_links")).first()[0] >= 0.9 * ((v @ v.T >= 0.3).sum() - len(v))


def test_chat(spark):
    rows = [
        (1, 0, "user", "hi <|end|>\n there"), (1, 2, "user", None), (1, 1, "assistant", "a\\<|b<\\|"), (2, 0, "assistant", ""), (None, 0, None, "x"),
        (3, 0, "assistant", "<|turn|>user<|body|>"), (3, 1, "assistant", "é\U0001f600"), (3, 1, "assistant", "é\U0001f600"), (4, 5, "system<|x", "&lt;"),
    ]
    table = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, segments string")
    events = table.select("conv_id", F.col("turn").alias("seq"), F.lit(None).cast("string").alias("kind"), F.col("turn").alias("msg"), "role", "text")
    got = {r.conv_id: r for r in chat.digest(chat.render(chat.fold_events(events))).collect()}
    for conv in (1, 2, 3, 4, None):
        turns = sorted((t, r or "", x or "") for c, t, r, x in rows if c == conv)
        said = "".join(x for _, r, x in turns if r == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat.digest(chat.render(chat.fold_events(none_of(events)))).count() == 0


def test_events_fold(spark):
    log = [
        (1, 0, "message", 0, "user", "hello"), (1, 1, "message", 1, "assistant", "Wel"), (1, 3, "delta", 1, None, "me"), (1, 2, "delta", 1, None, "co"),
        (1, 4, "edit", 0, None, "hello!"), (1, 5, "regenerate", 1, None, ""), (1, 6, "delta", 1, None, "Hi"), (1, 7, "delta", 1, None, " there"),
        (2, 0, "message", 0, "user", "a"), (2, 1, "delta", 0, None, "b"), (2, 2, "delta", 9, None, "lost"), (3, 0, "delta", 1, None, "never opened"),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, kind string, msg long, role string, text string")
    got = {r.conv_id: [(m.role, m.text) for m in r.messages] for r in chat.fold_events(events).collect()}
    assert got == {1: [("user", "hello!"), ("assistant", "Hi there")], 2: [("user", "ab"), ("", "lost")], 3: [("", "never opened")]}


def test_html_held_out():
    model, draw, wrong, all_ = html.train(), random.Random(1234), 0, 0
    for _ in range(200):
        nodes = html.parse(html.labelled_page(draw))
        html.label(nodes)
        for node, odds in zip(nodes, model.marginals(nodes)):
            if node.parts is not None:
                wrong, all_ = wrong + ((odds > 0) != node.label), all_ + 1
    assert wrong <= 0.01 * all_


def test_marginals_equal_enumeration():
    from itertools import product
    from math import exp, log

    model, draw = html.train(), random.Random(2)
    nodes = html.parse("<body><nav><a href=x>one</a></nav><article><h1>two</h1><p>three four</p></article><div class=ad>five</div></body>")
    own = [sum(model.weights.get(f, 0.0) for f in ["bias", *html.features(n, c)]) for n, c in zip(nodes, html.contexts(nodes))]
    mass = np.zeros((len(nodes), 2))
    for labels in product((0, 1), repeat=len(nodes)):
        score = sum(o for o, x in zip(own, labels) if x)
        for node, x in zip(nodes, labels):
            if node.parent >= 0:
                score += model.ties["#" if node.parts is not None else "b"][2 * labels[node.parent] + x]
        for k, x in enumerate(labels):
            mass[k, x] += exp(score)
    assert np.allclose([log(m[1] / m[0]) for m in mass], model.marginals(nodes), atol=1e-6)
    assert draw.random() < 1


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("<p>", ""), ("plain", None),
        ("<html><head><title>t</title><style>x</style></head><body><nav><a href=a>menu</a></nav><article><h1>A &amp; B</h1><p>one\n two&nbsp;three<br>four<p>five <b>six</b></article><footer>no</footer></body>", "A & B\n\none two three four\n\nfive six"),
        ("<main><h1>Head</h1><p>One.</p><p>Two.</p><form action=/s><p>Sign up for our newsletter</p><input></form><div class='comments'><p>a long reader comment that looks like text</p></div></main>", "Head\n\nOne.\n\nTwo."),
        ("<div class='nav'>Home | News</div><div id='main'><h1>T</h1><div>Some anonymous text.<br>More.</div><p>End.</div><div class='footer'>Contact</div>", "T\n\nSome anonymous text. More.\n\nEnd."),
        ("<body><article><p>kept text here</p><script>var t='</p>';</script><!-- no --><div class='comments'><p>I agree with this.</p></div></article>", "kept text here"),
    ],
)
def test_html_pages(page, text):
    got = html.extract(page, html.train())
    assert isinstance(got, str) if text is None else got == text


def test_html_table(spark):
    rows = [(1, "u", "<article><p>some words in a paragraph.</p></article>", "x"), (2, None, None, "y"), (2, None, None, "y"), (None, "v", "<" * 3000, "z")]
    got = html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id == 1] == ["some words in a paragraph."]


def test_changes_to_no_message(spark):
    log = [(1, 0, "message", 0, "user", "a"), (1, None, "delta", None, None, "lost"), (1, None, "message", None, "user", "first"), (4, None, "delta", None, None, "lost")]
    events = spark.createDataFrame(log, "conv_id long, seq long, kind string, msg long, role string, text string")
    got = {r.conv_id: [(m.role, m.text) for m in r.messages] for r in chat.fold_events(events).collect()}
    assert got == {1: [("", "lost"), ("user", "first"), ("user", "a")], 4: [("", "lost")]}


def test_a_first_change_opens_a_message(spark):
    """Conversations of deltas only, edits before any opening, and roles that a change brings along."""
    log = [
        (1, 3, "delta", 7, "assistant", "Hel"), (1, 4, "delta", 7, None, "lo"), (1, 5, "edit", 8, "user", "new"), (1, 6, "delta", 8, None, "!"),
        (2, 1, "delta", 1, None, "a"), (2, 0, "regenerate", 1, "assistant", "b"), (2, 5, "message", 5, "user", "z"), (3, None, "edit", 2, "user", "x"),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, kind string, msg long, role string, text string")
    got = {r.conv_id: [(m.role, m.text) for m in r.messages] for r in chat.fold_events(events).collect()}
    assert got == {1: [("assistant", "Hello"), ("user", "new!")], 2: [("assistant", "ba"), ("user", "z")], 3: [("user", "x")]}


def test_turns_come_back_from_their_events(spark, small):
    rows = spark.createDataFrame([(1, 0, "user", "ab"), (1, 1, "assistant", None), (1, 2, "user", "<|end|>\n é"), (1, 2, "user", "<|end|>\n é"), (1, 3, "assistant", "x" * 9), (2, 0, None, "")], "conv_id long, turn long, role string, text string")
    log = chat.as_events(rows)
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    got = {r.conv_id: [(m.role, m.text) for m in r.messages] for r in chat.fold_events(log).collect()}
    assert got == {1: [("user", "ab"), ("assistant", ""), ("user", "<|end|>\n é"), ("user", "<|end|>\n é"), ("assistant", "x" * 9)], 2: [("", "")]}
