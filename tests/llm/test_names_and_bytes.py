"""Names that lie about article text, hidden elements, texts of any bytes, samples that don't depend on row order."""

import pytest
from pyspark.sql import functions as F

from gridweave.llm import html_text, quality, simhash, substring_dedup, token_counts, toxicity
from gridweave.llm.labelled import training_rows

DIR = "/root/testdata/sf0.01"
TEXT = [
    "A longer paragraph of the article tells what was found there in the year before.", "It goes on, as articles do, with a second sentence that isn't short either.",
    "The part in question holds a sentence of its own, of usual length and form.",
]
#: Parts of an article whose names could be furniture's.
KEPT = ["<p class='comment-on-history'>{2}</p>", "<div class='negative feedback loop'><p>{2}</p></div>", "<section class='related-work'><p>{2}</p></section>", "<section id='discussion'><p>{2}</p></section>", "<p class='notice'>{2}</p>"]
#: What follows an article without a telling name.
DROPPED = [
    "<template><p>{2}</p></template>", "<div style='display:none'><p>{2}</p></div>", "<p hidden>{2}</p>", "<section><p>Nice one, thank you!</p><p>I disagree with all of it.</p></section>",
    "<div><h3>Archive</h3><ul><li><a href=a>May</a></li><li><a href=b>June</a></li></ul></div>", "<div>© 2024 Some Company. All rights reserved.</div>",
]


@pytest.fixture(scope="module")
def fitted(spark):
    return html_text.fit(spark.read.parquet(f"{DIR}/pages.parquet"))


def test_article_text_under_furniture_names_is_kept(fitted):
    for part in KEPT:
        page = f"<nav><a href=/>Home</a></nav><article><h1>Head</h1><p>{{0}}</p>{part}<p>{{1}}</p></article><footer>f</footer>"
        assert html_text.main_text(page.format(*TEXT), *fitted) == "\n".join(["Head", TEXT[0], TEXT[2], TEXT[1]]), part
    for part in DROPPED:
        assert html_text.main_text(f"<article><p>{{0}}</p><p>{{1}}</p></article>{part}".format(*TEXT), *fitted) == "\n".join(TEXT[:2]), part
    hidden = "<article><p>{0}</p><template><p>{2}</p></template><div hidden><p>{2}</p></div><p>{1}</p></article>"
    assert html_text.main_text(hidden.format(*TEXT), *fitted) == "\n".join(TEXT[:2])


def test_whole_pages_stay_right_with_and_without_their_mark(spark, fitted):
    wrong = 0
    for (markup,) in spark.read.parquet(f"{DIR}/pages.parquet").select("html").collect():
        page = html_text.Page(markup or "")
        labels = html_text.marked_labels(page)
        if labels is not None:
            article = "\n".join(text for node, text in page.blocks if labels[node])
            bare = markup
            for mark in ("article", "main"):
                bare = bare.replace(f"<{mark}", "<div").replace(f"</{mark}", "</div")
            wrong += (html_text.main_text(markup, *fitted) != article) + (html_text.main_text(bare, *fitted) != article)
    assert wrong == 0


def test_fitted_messages_change_a_block_for_the_better(fitted):
    """Loose words under a doubtful name in an unmarked article: dropped by their own potential, kept by their surroundings."""
    weights, edges = fitted
    markup = "<div><nav><a href=/>Home</a></nav><div><p>{0}</p><p>{1}</p><div class='links list'><span>See</span> <a href=x>that page</a></div></div></div>".format(*TEXT)
    page = html_text.Page(markup)
    odds = html_text.features(page) @ weights
    node = next(n for n, text in page.blocks if text == "See that page")
    assert odds[node] < 0 and html_text.marginals(page.parents, odds.tolist(), edges)[node] > 0.5
    assert html_text.main_text(markup, *fitted) == "\n".join([*TEXT[:2], "See that page"])
    assert max(abs(weights[html_text.FEATURES.index(f)]) for f in ("good name", "bad name", "doubtful name", "under bad name")) < 2.5


def test_texts_of_any_bytes(spark):
    rows = spark.createDataFrame([(i, f"some words of text number {i} " * 20) for i in range(6)], "doc_id long, text string")
    broken = rows.where("doc_id < 2").select("doc_id", F.expr("cast(concat(cast(text as binary), x'ff41c3') as string)").alias("text"))
    docs = rows.where("doc_id >= 2").unionByName(broken)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(6)], "doc_id long, quality int, toxic int")
    whole = spark.createDataFrame([(i, f"some words of text number {i} " * 20 + ("�A�" if i < 2 else "")) for i in range(6)], "doc_id long, text string")
    ordered = lambda df: sorted(map(tuple, df.collect()))
    for run in (simhash.near_groups, token_counts.token_counts, substring_dedup.remove_repeats):
        assert ordered(run(docs)) == ordered(run(whole))
    for run in (toxicity.toxicity, quality.quality):  # whose shards, and so last digits, go by partitions
        assert [r.score for r in run(docs, labels).orderBy("doc_id").collect()] == pytest.approx([r.score for r in run(whole, labels).orderBy("doc_id").collect()], abs=1e-3)
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    assert html_text.extract(pages).count() == 6


def test_training_rows_do_not_depend_on_order(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (1, None), (2, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (1, None), (2, 1)], "doc_id long, toxic int")
    seen = {tuple(sorted(map(tuple, training_rows(d.repartition(n), lab.repartition(n), "toxic", 1, 5, 10).collect()))) for n in (1, 3) for d in (docs, docs.orderBy(F.desc("text"))) for lab in (labels, labels.orderBy("toxic"))}
    assert len(seen) == 1 and {(r[0], r[2]) for r in next(iter(seen))} == {(1, 0), (2, 1)}
