"""ISO media containers with several tracks and rare boxes; WARC archives that are merged in many ranges."""

import random
import struct

from pyspark.sql import functions as F

from millrace.llm import isomedia, warc


def track(handler, codec, sizes, chunk_offsets, wide=False, version=0, packed=0, keys=None):
    """A trak box: one sample a chunk."""
    full, box = isomedia._full, isomedia.box
    head = struct.pack(">QQIQ", 0, 0, 48_000, 1 << 33) if version else struct.pack(">4I", 0, 0, 600, 1200)
    if packed == 4:
        even = sizes + [0] * (len(sizes) % 2)
        table = full(b"stz2", bytes([0, 0, 0, 4]), struct.pack(">I", len(sizes)), bytes(a << 4 | b for a, b in zip(even[::2], even[1::2], strict=True)))
    elif packed:
        table = full(b"stz2", bytes([0, 0, 0, packed]), struct.pack(f">I{len(sizes)}{'BH'[packed // 8 - 1]}", len(sizes), *sizes))
    else:
        table = full(b"stsz", struct.pack(f">2I{len(sizes)}I", 0, len(sizes), *sizes))
    offsets = full(b"co64", struct.pack(f">I{len(sizes)}Q", len(sizes), *chunk_offsets)) if wide else full(b"stco", struct.pack(f">I{len(sizes)}I", len(sizes), *chunk_offsets))
    sync = full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *(k + 1 for k in keys))) if keys is not None else b""
    stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(codec, bytes(8))), full(b"stts", struct.pack(">3I", 1, len(sizes), 2)), full(b"stsc", struct.pack(">4I", 1, 1, 1, 1)), table, offsets, sync)
    return box(b"trak", box(b"mdia", full(b"mdhd", head, bytes(4), version=version), full(b"hdlr", bytes(4), handler, bytes(13)), box(b"minf", stbl)))


def test_every_track_is_indexed(spark):
    box = isomedia.box
    wide = struct.pack(">I4sQ", 1, b"free", 20) + bytes(4)  # a box with a 64-bit size
    moov = box(b"moov", track(b"soun", b"mp4a", [3, 15, 1], [1000, 1100, 1200], packed=4), track(b"vide", b"avc1", [70_000, 5], [2000, 90_000], wide=True, version=1, keys=[1]), track(b"text", b"tx3g", [7, 9], [5, 50], packed=16))
    data = box(b"ftyp", b"isom") + wide + moov + box(b"mdat", b"xyz")
    df = spark.createDataFrame([(1, 0, bytearray(data)), (1, 0, bytearray(data)), (2, 0, bytearray(box(b"ftyp", b"isom"))), (3, 0, bytearray(data[:-20])), (4, 0, None)], "doc_id long, n_bytes long, media binary")
    got = {r["doc_id"]: r for r in isomedia.index_media(df).collect()}
    assert [(t["handler"], t["codec"], t["timescale"], t["duration"], t["n_samples"], [tuple(k) for k in t["keyframes"]]) for t in got[1]["tracks"]] == [
        ("soun", "mp4a", 600, 1200, 3, [(1000, 1003), (1100, 1115), (1200, 1201)]),
        ("vide", "avc1", 48_000, 1 << 33, 2, [(90_000, 90_005)]),
        ("text", "tx3g", 600, 1200, 2, [(5, 12), (50, 59)]),
    ]
    assert got[1]["error"] is None and (got[2]["error"], got[2]["tracks"]) == ("no track", None) and got[3]["error"] and got[4]["error"] == "no media"
    assert isomedia.index_media(df.limit(0)).count() == 0


def test_merge_in_many_ranges_and_runs(spark, monkeypatch):
    monkeypatch.setattr(warc, "SEGMENT_BYTES", 2_000)
    r = random.Random(5)
    rows = [(i, f"http://h{r.randint(0, 3)}.example/{r.randint(0, 5)}", r.choice(["same", "", None, f"own {i}"]), 1, "x") for i in range(600)] + [(7, "http://h0.example/1", "z" * 300_000, 1, "x"), (None, None, None, 1, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, sha int, segment string").repartition(3)
    runs = warc.read_archives(warc.write_archives(df))
    assert runs.select("segment").distinct().count() > 5
    merged = warc.merge_index(runs, 50)
    assert merged.rdd.getNumPartitions() >= 10
    got = [warc._order(tuple(x)) for x in merged.collect()]
    assert got == sorted(got) and len(got) == len(rows)
    assert sorted(map(str, runs.collect())) == sorted(map(str, merged.collect()))
    assert merged.agg(F.max("payload_bytes")).first()[0] == 300_000
