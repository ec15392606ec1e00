"""Operators use all of their input."""

import collections
import random
import tracemalloc
from pathlib import Path

import pyarrow as pa
import pytest

import corpus_pipeline
from gridskein.llm import _common, chat, html_extract, language_id, lm_scoring
from gridskein.llm import queries as llm

from ..oracle import compare, connect


def test_all_training_documents_train_the_weights(spark):
    docs = spark.createDataFrame([(k, f"a b{k % 7} c {k}") for k in range(200)], "doc_id long, text string").repartition(3)
    model = lm_scoring.train_language_model(docs)
    assert model.trained == model.tokens == 1000


def _links(messages):
    """{(conv, turn): (reply_to, n_linked)} by brute force; messages are (conv, turn, role, text)."""
    out = {}
    for conv, turn, _, text in messages:
        votes = collections.defaultdict(collections.Counter)
        for line in text.split("\n"):
            mark = line.replace(" ", "")
            level, plain = len(mark) - len(mark.lstrip(">")), line.lstrip("> ").lower().strip()
            earlier = [t for c, t, _, x in messages if c == conv and t < turn and plain in [y.lower().strip() for y in x.split("\n") if not y.startswith(">")]]
            if level and plain and earlier:
                votes[level][max(earlier)] += 1
        reply = max((n, t) for t, n in votes[min(votes)].items())[1] if votes else None
        out[conv, turn] = reply, sum(sum(v.values()) for v in votes.values())
    return out


@pytest.mark.parametrize("block", [4096, 3])
def test_nested_quotes_are_linked(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    rng = random.Random(4)
    # The second conversation's turn 3 quotes nested text only; its turn 4's level 1 original is in no message.
    messages = [(8, 1, "user", "alpha"), (8, 2, "user", "beta"), (8, 3, "user", "> > alpha\nyes"), (8, 4, "user", "> gone\n>> beta\n>> beta\n> > > alpha"), (8, 5, "user", "> alpha\n>> beta\n>> beta")]
    for turn in range(12):
        marks = [rng.choice(["", "> ", ">> ", "> > > "]) for _ in range(4)]
        messages.append((9, turn, "user", "\n".join(f"{m}line {rng.randint(0, 15)}" for m in marks)))
    spark.createDataFrame(messages, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = llm.op5_quotation_linking(spark, str(tmp_path)).collect()
    found = {(r.conv_id, r.turn): (r.reply_to, r.n_linked) for r in rows}
    assert found == _links(messages)
    assert compare(connect(str(tmp_path)), llm.op5_quotation_linking(spark, str(tmp_path)).toPandas(), llm.ORACLE_SQL["op5_quotation_linking"]) == ""
    assert [found[8, k][0] for k in (3, 4, 5)] == [1, 2, 1]
    assert {r.turn: r.thread for r in rows if r.conv_id == 8} == {1: 1, 2: 2, 3: 1, 4: 2, 5: 1}


def test_boilerplate_is_counted_in_pages(spark):
    notice = "please note that this shop is closed on all public holidays"
    pages = [(k, f"http://a.example/{k}", f"<p>first text {k} of this page with its own words</p>{f'<p>{notice}</p>' if k < 4 else ''}<p>last text {k} of this page with its own words</p>") for k in range(40)]
    pages += [(100 + k, f"http://b.example/{k}", f"<p>text {k} of this page</p><p>{notice}</p>") for k in range(2)]
    found = html_extract.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.page_id for r in found if notice in r.main_text} == {100, 101}
    assert all(f"first text {r.page_id} of" in r.main_text and f"last text {r.page_id} of" in r.main_text for r in found if r.page_id < 100)


def test_stages_hand_small_batches_to_python(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"]) for b in batches)
    stage = corpus_pipeline._in_small_batches(lambda s, docs, d: docs.mapInArrow(sizes, "n long, size long").collect())
    found = stage(spark, spark.range(0, 4000, 1, 1).selectExpr("repeat('x', 5000) AS text"), "")
    assert sum(r.n for r in found) == 4000 and max(r.size for r in found) < 1.2 * corpus_pipeline.BATCH
    assert spark.conf.get(key) == before
    assert all(f.__wrapped__ for _, f in corpus_pipeline.STAGES)


def test_a_kernels_leftovers_go_back_to_the_system():
    def resident():
        return int(Path("/proc/self/statm").read_text().split()[1]) * 4096

    def rows(batches):
        for batch in batches:
            kept = [bytes(2000 + k % 100) for k in range(100_000)]
            self_kept.append(kept[-1])  # holds the top of the heap
            del kept
            yield batch

    self_kept = []
    batch = pa.RecordBatch.from_arrays([pa.array([1])], ["a"])
    began = resident()
    assert list(rows([batch])) == [batch]
    left = resident() - began
    assert list(_common.freeing(rows)([batch])) == [batch]
    assert left > 150e6 and resident() - began < 100e6


def test_tables_of_letters_are_made_without_a_list_of_all_characters(monkeypatch):
    monkeypatch.setattr(language_id, "_TABLES", [])
    tracemalloc.start()
    letter, lower, script = language_id._tables()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert letter[ord("\u00e9")] and lower[ord("\u00c9")] == ord("\u00e9") and script[ord("a")] == 1
    assert peak < 60e6
