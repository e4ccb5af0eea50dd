"""Benchmark blocks stay small when one id, or one row, fills the benchmark."""

import brute
import edge_cases

from doclint.llm import decontaminate


def test_blocks_of_a_hot_id_are_bounded(spark, monkeypatch):
    rows = edge_cases.rows()
    passage = " ".join((rows[8][1] or "").split(" ")[2:9])
    items = [("hot" if i % 2 else None, f"w{i} a{i} b{i} c{i} d{i}") for i in range(200)] + [("hot", passage)] * 100
    sizes, build = [], decontaminate.build_index
    monkeypatch.setattr(decontaminate, "BLOCK", 2000)
    monkeypatch.setattr(decontaminate, "build_index", lambda docs, mine, text: sizes.append(sum(len(t) + 16 for _, t in mine)) or build(docs, mine, text))
    found = decontaminate.flag(edge_cases.frame(spark), spark.createDataFrame(items, "item_id string, text string"), prefix="z_").select("doc_id", "z_hits", "z_items").collect()
    assert len(sizes) > 2 and max(sizes) < 2 * decontaminate.BLOCK
    want = brute.contamination([r[1] for r in rows], [(i or "", t) for i, t in items])
    key = lambda r: (r[0] is None, r[0], r[1:])
    assert sorted(((r.doc_id, len(r.z_hits), r.z_items) for r in found), key=key) == sorted(((r[0], h, i) for r, (_, h, i) in zip(rows, want, strict=True)), key=key)
