"""Piece sampling with little memory, as the pipeline's last stage runs it."""

import numpy as np

from lodestone.llm import piece_sampling as ps

import corpus_pipeline


def test_lean_sampling_gives_the_same_rows_and_keeps_few_edges(spark):
    rows = [(k, " ".join(f"w{k * 7919 + j * 104729:x}" for j in range(1500))) for k in range(12)] + [(12, None), (13, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    model = ps.model_bytes()
    full, lean = (sorted(map(tuple, ps.encoded(df, model, keep_text=False, lean=x).collect()), key=lambda r: (r[0], r[1])) for x in (False, True))
    assert len(full) == 12 * 3 + 2 and lean == full

    pieces, text = ps.Pieces.loaded(model), np.frombuffer("".join(t or "" for _, t in rows).encode(), np.uint8)
    pieces.kept = ps.Kept(1000)
    cut = np.linspace(0, len(text), 9).astype(np.int64)
    for i in range(8):
        alone = ps.Pieces.loaded(model)
        ps.Lattice(alone, text, cut, i, i + 1)
        ps.Lattice(pieces, text, cut, i, i + 1)
        assert 1000 < pieces.kept.edges <= 1000 + alone.kept.edges


def test_last_stage_is_lean(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(ps, "encoded", lambda df, model, **more: seen.update(more) or df)
    corpus_pipeline.sample_pieces(spark, spark.createDataFrame([(1, "en", "s", "a b")], "doc_id long, lang string, source string, text string"), "")
    assert seen["lean"] and not seen["keep_text"]
