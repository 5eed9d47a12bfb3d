import random

from lectern.llm import mpegts


def test_round_trip_of_payloads_of_every_length():
    rng = random.Random(0)
    for n in [0, 1, 161, 162, 163, 345, 346, 347, 529, 530, 531, 12288, 12289, 40000, *range(150, 200)]:
        for unit in (192, 1000, mpegts.UNIT):
            payload = rng.randbytes(n)
            media = mpegts.mux_bytes(payload, unit)
            got = mpegts.demux_bytes(media)
            assert len(media) % 188 == 0 and got.payload == payload, n
            assert (got.sync_errors, got.crc_errors, got.counter_errors, got.repeated, got.damaged_units) == (0,) * 5
            if n:
                assert got.programs == [1] and got.streams == [(0x100, 6)]
                assert [u[0] for u in got.units] == [3600 * k for k in range(-(-n // unit))] and all(u[3] for u in got.units)


def test_known_section_crc():
    assert mpegts.section_crc(b"123456789") == 0x0376E6E7


def test_time_stamps_use_33_bits():
    for t in (0, 1, 90_000, 2**33 - 1, 0x123456789):
        assert mpegts.read_stamp(mpegts.write_stamp(2, t)) == t


def packets(media):
    return [media[i : i + 188] for i in range(0, len(media), 188)]


def test_damage_is_counted():
    payload = bytes(range(256)) * 30
    rows = packets(mpegts.mux_bytes(payload))
    assert mpegts.demux_bytes(b"".join(rows[:6] + rows[5:])).repeated == 1
    assert mpegts.demux_bytes(b"".join(rows[:6] + rows[5:])).payload == payload
    lost = mpegts.demux_bytes(b"".join(rows[:6] + rows[7:]))
    assert lost.counter_errors == 1 and lost.damaged_units == 1
    broken = mpegts.demux_bytes(b"".join([b"\x00" + rows[0][1:], *rows[1:]]))
    assert broken.sync_errors == 1
    bad_table = bytearray(rows[0])
    bad_table[10] ^= 1
    assert mpegts.demux_bytes(b"".join([bytes(bad_table), *rows[1:]])).crc_errors == 1
    assert mpegts.demux_bytes(b"").payload == mpegts.demux_bytes(b"\x47" * 100).payload == b""


def test_sections_over_several_packets():
    entries = b"".join((0xE000 | 0x200 + k).to_bytes(2, "big").join([b"\x06", b"\xf0\x00"]) for k in range(60))
    pmt = mpegts.section(2, 1, b"\xe2\x00\xf0\x00" + entries)
    first = bytes([0x47, 0x50, 0x00, 0x10, 0]) + pmt[:183]
    second = (bytes([0x47, 0x10, 0x00, 0x11]) + pmt[183:]).ljust(188, b"\xff")
    got = mpegts.demux_bytes(mpegts.table_packet(0, 0, mpegts._PAT) + first + second)
    assert len(got.streams) == 60 and got.crc_errors == 0


def test_query(run_op, frame, spark):
    texts = ["", None, " ", "x" * 192, "é" * 96, "y" * 193, "long " * 20_000, "same", "same"]
    rows = {r.doc_id: r for r in run_op("op1_mpeg_ts", documents=frame(texts)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == mpegts.expected(t)
        assert r.media_bytes % 188 == 0 and r.feature.endswith("errors=0")
    assert rows[7][1:] == rows[8][1:]


def test_other_columns_and_empty_table(spark, frame):
    docs = frame([(None, "a"), (1, None)]).selectExpr("doc_id", "text", "1 as media", "2 as payload", "3 as units")
    parsed = mpegts.demux(mpegts.mux(docs))
    assert parsed.count() == 2 and mpegts.digests(parsed).count() == 2
    assert mpegts.demux(mpegts.mux(docs.limit(0))).count() == 0
    assert mpegts.demux(spark.createDataFrame([(None,)], "media binary")).first().packets == 0
