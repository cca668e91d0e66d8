"""The streaming forms give what the batch forms give."""

import json

from docflow.kernels.embedding import HashEmbedder
from docflow.operators.extract import preset
from docflow.streaming import ingest


def test_files_to_records(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for name, text in (("a.txt", "alpha\n\nbeta"), ("b.md", "# T\nbody"), ("copy.txt", "alpha\n\nbeta"), ("c.bin", "x")):
        (source / name).write_text(text)
    stream = ingest.file_stream(spark, str(source))
    chunks = ingest.chunk_stream(stream, preset(), max_tokens=2, no_overlap=True)
    out = [str(tmp_path / n) for n in ("records", "failures", "checkpoint")]
    query = ingest.embed_sink(chunks, lambda: HashEmbedder(4), *out).trigger(availableNow=True).start()
    query.awaitTermination(120)
    records = spark.read.parquet(out[0])
    texts = sorted(r.text.strip() for r in records.collect())
    assert texts == ["# T\nbody", "alpha", "beta"]
    assert json.loads(json.dumps(records.columns))[0] == "pos"
