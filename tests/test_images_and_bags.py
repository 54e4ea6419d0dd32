import bz2
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.sources import bags, images


def png(pixels, filters=None, depth=8, colour=None, palette=None, interlaced=0):
    """A PNG file of (height, width, channels) bytes, each row under the given filter."""
    height, width, channels = pixels.shape
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[channels] if colour is None else colour
    raw = pixels.astype(np.uint8)
    if depth == 16:
        raw = np.stack([raw, np.full_like(raw, 7)], axis=3).reshape(height, width, -1)
    size, data, above = raw.shape[2], b"", np.zeros(width * raw.shape[2], int)
    for y in range(height):
        kind, row, line = (filters or [0])[y % len(filters or [0])], raw[y].ravel().astype(int), []
        for i, v in enumerate(row):
            a, b, c = row[i - size] if i >= size else 0, above[i], above[i - size] if i >= size else 0
            p = a + b - c
            nearest = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
            line.append((v - (0, a, b, (a + b) // 2, nearest)[kind]) % 256)
        data, above = data + bytes([kind]) + bytes(line), row

    def chunk(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    plte = chunk(b"PLTE", palette.astype(np.uint8).tobytes()) if palette is not None else b""
    packed = zlib.compress(data)
    return images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlaced)) + plte + chunk(b"IDAT", packed[:9]) + chunk(b"IDAT", packed[9:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_png_files_round_trip(channels):
    rng = np.random.default_rng(channels)
    for shape in ((1, 1), (5, 7), (12, 3), (1, 9), (9, 1)):
        pixels = rng.integers(0, 256, (*shape, channels)).astype(np.uint8)
        for filters in ([0], [1], [2], [3], [4], [0, 4, 3, 2, 1]):
            assert np.array_equal(images.decode_png(png(pixels, filters)), pixels)
            assert np.array_equal(images.decode_png(png(pixels, filters, depth=16)), pixels)


def test_palettes_and_files_that_are_not_read():
    palette = np.arange(12).reshape(4, 3) * 10
    assert np.array_equal(images.decode_png(png(np.array([[[3], [0]], [[1], [2]]]), [1], colour=3, palette=palette)), palette[[[3, 0], [1, 2]]])
    good = png(np.zeros((4, 4, 3)))
    for bad, said in ((b"GIF89a", "no PNG"), (png(np.zeros((2, 2, 1)), interlaced=1), "interlaced"), (png(np.full((1, 1, 1), 9), colour=3, palette=palette), "palette"), (good[:-40], "bytes of pixels|incomplete|head")):
        with pytest.raises((ValueError, zlib.error), match=said):
            images.decode_png(bad)


def test_gray_has_three_rules(spark):
    cells = np.random.default_rng(2).integers(0, 256, (500, 3)).astype(np.uint8)
    exact = cells @ np.array([0.299, 0.587, 0.114])
    assert np.array_equal(images.gray_cells(cells, "luma"), np.floor(exact))
    assert np.abs(images.gray_cells(cells, "luma_rounded") - exact).max() <= 0.51
    assert images.gray_cells(cells, "mean") == pytest.approx(cells.mean(axis=1) / 255)
    assert images.gray_cells(np.array([[1], [0]], np.uint8), "mean").tolist() == [1.0, 0.0]
    assert images.gray_cells(np.array([[9, 255]], np.uint8), "luma").tolist() == [9.0]
    with pytest.raises(ValueError, match="unknown rule"):
        images.gray(F.col("image"), "green")


@pytest.fixture
def sequence(tmp_path):
    """Ten frames, of which only the middle ones can be decoded; a table of their times, and a file it doesn't name."""
    (tmp_path / "rgb" / "deep").mkdir(parents=True)
    rng, pixels = np.random.default_rng(3), {}
    for i in range(10):
        name = f"rgb/{'deep/' * (i % 2)}f{i}.png"
        pixels[name] = rng.integers(0, 256, (6, 8, 3)).astype(np.uint8)
        (tmp_path / name).write_bytes(png(pixels[name], [4]) if 3 <= i <= 6 else b"broken")
    (tmp_path / "rgb" / "other.png").write_bytes(b"broken")
    (tmp_path / "rgb" / "note.txt").write_text("no image")
    (tmp_path / "times.csv").write_text("timestamp_s,path\n" + "".join(f"{i / 10},rgb/{'deep/' * (i % 2)}f{i}.png\n" for i in range(10)))
    return tmp_path, pixels


def test_only_rows_that_are_left_are_decoded(spark, sequence):
    root, pixels = sequence
    frames = images.scan_images(spark, str(root), images.image_times(spark, str(root / "times.csv")))
    assert frames.drop("image").count() == 10 and frames.select("t").count() == 10  # nothing is decoded
    for kept in (frames.where("t between 0.3 and 0.6"), frames.drop("image").join(spark.createDataFrame([(0.4,)], "t double"), "t", "left_semi").withColumn("image", images.decoded("file"))):
        rows = kept.collect()
        assert len(rows) in (1, 4)
        for r in rows:
            assert np.array_equal(np.frombuffer(r.image.pixels, np.uint8).reshape(6, 8, 3), pixels[r.rel_path])
    cells = frames.where("t = 0.5").select(images.gray(F.col("image")).alias("g")).first().g
    assert cells == np.floor(pixels["rgb/deep/f5.png"].reshape(-1, 3).astype(float) @ np.array(images.LUMA)).tolist()
    with pytest.raises(Exception, match="f1.png: no PNG"):
        frames.where("t = 0.1").collect()


def test_frames_without_times_and_without_files(spark, sequence):
    root, _ = sequence
    rows = images.scan_images(spark, str(root / "rgb")).drop("image").orderBy("t").collect()
    assert [r.t for r in rows] == [float(i) for i in range(11)] and [r.rel_path for r in rows] == sorted(r.rel_path for r in rows)
    times = images.image_times(spark, str(root / "times.csv")).select("t", "rel_path").union(spark.createDataFrame([(9.0, "rgb/gone.png")], "t double, rel_path string"))
    with pytest.raises(Exception, match="no such image frame: rgb/gone.png"):
        images.scan_images(spark, str(root), times).select("file").collect()
    missing = images.scan_images(spark, str(root), times, strict=False).where("t = 9").first()
    assert missing.file is None and missing.image.pixels is None
    (root / "bad.csv").write_text("t,frame_path\n0.1,a.png\nlater,b.png\n")
    assert [r.problem for r in images.image_times(spark, str(root / "bad.csv"), strict=False).orderBy("rel_path").collect()] == [None, "t: later"]
    with pytest.raises(Exception, match="bad row"):
        images.image_times(spark, str(root / "bad.csv")).collect()
    (root / "none.csv").write_text("t,name\n0.1,a.png\n")
    with pytest.raises(ValueError, match="no column for an image"):
        images.image_times(spark, str(root / "none.csv"))


# --- Bags ---

START = 1_500_000_000


def header(t):
    return struct.pack("<III", 0, int(t), round((t - int(t)) * 1e9)) + struct.pack("<I", 3) + b"cam"


def imu_message(t, a, g):
    return header(t) + struct.pack("<4d", 0, 0, 0, 1) + struct.pack("<9d", *[0] * 9) + struct.pack("<3d", *g) + struct.pack("<9d", *[0] * 9) + struct.pack("<3d", *a) + struct.pack("<9d", *[0] * 9)


def pose_message(t, p):
    return header(t) + struct.pack("<7d", *p)


def image_message(t, pixels):
    h, w = pixels.shape
    return header(t) + struct.pack("<II", h, w) + struct.pack("<I", 5) + b"mono8" + struct.pack("<BII", 0, w, h * w) + pixels.tobytes()


def events_message(t, events):
    return header(t) + struct.pack("<III", 260, 346, len(events)) + b"".join(struct.pack("<HHIIB", x, y, int(s), round((s - int(s)) * 1e9), p > 0) for s, x, y, p in events)


def pack(values, data):
    head = b"".join(struct.pack("<I", len(k) + 1 + len(v)) + k.encode() + b"=" + v for k, v in values.items())
    return struct.pack("<I", len(head)) + head + struct.pack("<I", len(data)) + data


def stamp(t):
    return struct.pack("<II", int(t), round((t - int(t)) * 1e9))


def u32(n):
    return struct.pack("<I", n)


def write_bag(path, topics, messages, size, compress=False, spoil=()):
    """topics: name -> type; messages: (time of recording, topic, data), dealt into chunks of so many. Chunks in `spoil` are
    overwritten with rubbish."""
    numbers = {t: i for i, t in enumerate(topics)}

    def connection(t):
        return pack({"op": b"\x07", "conn": u32(numbers[t]), "topic": t.encode()}, b"".join(u32(len(x)) + x for x in (b"topic=" + t.encode(), b"type=" + topics[t].encode(), b"md5sum=*")))

    body, infos = b"", []
    for k in range(0, len(messages), size):
        some = messages[k : k + size]
        data = b"".join(connection(t) for t in topics) + b"".join(pack({"op": b"\x02", "conn": u32(numbers[t]), "time": stamp(at)}, d) for at, t, d in some)
        packed = bz2.compress(data) if compress else data
        if k // size in spoil:
            packed = b"\xff" * len(packed)
        counts = {t: sum(m[1] == t for m in some) for t in topics}
        infos.append((4096 + len(bags.MAGIC) + len(body), min(m[0] for m in some), max(m[0] for m in some), {numbers[t]: n for t, n in counts.items() if n}))
        body += pack({"op": b"\x05", "compression": b"bz2" if compress else b"none", "size": u32(len(data))}, packed)
        body += pack({"op": b"\x04", "ver": u32(1), "conn": u32(0), "count": u32(0)}, b"")
    tail = b"".join(connection(t) for t in topics)
    tail += b"".join(pack({"op": b"\x06", "ver": u32(1), "chunk_pos": struct.pack("<Q", at), "start_time": stamp(a), "end_time": stamp(b), "count": u32(len(counts))}, b"".join(u32(c) + u32(n) for c, n in counts.items())) for at, a, b, counts in infos)
    head = {"op": b"\x03", "index_pos": struct.pack("<Q", 4096 + len(bags.MAGIC) + len(body)), "conn_count": u32(len(topics)), "chunk_count": u32(len(infos))}
    first = pack(head, b"")
    path.write_bytes(bags.MAGIC + pack(head, b" " * (4096 - len(first))) + body + tail)


TOPICS = {"/davis/left/imu": "sensor_msgs/Imu", "/davis/left/events": "dvs_msgs/EventArray", "/davis/left/pose": "geometry_msgs/PoseStamped", "/davis/left/image_raw": "sensor_msgs/Image"}


@pytest.fixture
def recorded():
    """100 moments, a tenth of a second apart, recorded a little late and not quite in order."""
    rng = random.Random(5)
    want = {"imu": [], "events": [], "pose": [], "image": []}
    messages = []
    for i in range(100):
        t = START + i / 10
        a, g, p = ([round(rng.uniform(-9, 9), 3) for _ in range(n)] for n in (3, 3, 7))
        events = [(round(t + j / 1000, 6), rng.randrange(346), rng.randrange(260), rng.choice((-1, 1))) for j in range(5)]
        pixels = np.array([[i, 1, 2], [3, 4, 5]], np.uint8)
        want["imu"].append((t, *a, *g))
        want["events"] += events
        want["pose"].append((t, *p))
        want["image"].append((t, 2, 3, "mono8", pixels.tobytes()))
        made = {"imu": imu_message(t, a, g), "events": events_message(t, events), "pose": pose_message(t, p), "image_raw": image_message(t, pixels)}
        messages += [(t + rng.uniform(0, 0.3), f"/davis/left/{k}", v) for k, v in made.items()]
    return sorted(messages), want


def near(rows, want):
    rows = sorted(tuple(r)[2:] for r in rows)
    assert len(rows) == len(want)
    for a, b in zip(rows, sorted(want), strict=True):
        assert [x for x in a if not isinstance(x, float)] == [x for x in b if not isinstance(x, float)]
        assert [x for x in a if isinstance(x, float)] == pytest.approx([x for x in b if isinstance(x, float)], abs=1e-6)


@pytest.mark.parametrize("compress", [False, True])
def test_bags_round_trip(spark, tmp_path, recorded, compress):
    messages, want = recorded
    write_bag(tmp_path / "a.bag", TOPICS, messages, 37, compress)
    for kind, topic in (("imu", "imu"), ("events", "events"), ("pose", "pose"), ("image", "image_raw")):
        near(bags.read_bag(spark, str(tmp_path / "a.bag"), kind, f"/davis/left/{topic}").collect(), want[kind])
    raw = spark.read.format("bag").option("path", str(tmp_path / "a.bag")).load()
    assert raw.count() == 400 and {r.message_type for r in raw.select("message_type").distinct().collect()} == set(TOPICS.values())
    first = messages[0][0]
    got = bags.read_bag(spark, str(tmp_path / "a.bag"), "events", "/davis/left/events", 2.0, 4.5).collect()
    near(got, [e for e in want["events"] if first + 2.0 <= e[0] <= first + 4.5])


def test_chunks_outside_the_window_are_not_read(spark, tmp_path, recorded):
    """Chunks beyond the window hold rubbish: reading one would fail."""
    messages, want = recorded
    first = messages[0][0]
    needed = {k // 20 for k, m in enumerate(messages) if first + 2.0 <= m[0] <= first + 6.0}
    path = tmp_path / "spoilt.bag"
    write_bag(path, TOPICS, messages, 20, spoil=set(range(20)) - needed)
    rows = bags.read_bag(spark, str(path), "imu", "/davis/left/imu", 3.0, 5.0)
    near(rows.collect(), [m for m in want["imu"] if first + 3.0 <= m[0] <= first + 5.0])
    assert rows.rdd.getNumPartitions() == len(needed) < 20
    with pytest.raises(Exception):
        bags.read_bag(spark, str(path), "imu", "/davis/left/imu").collect()


def test_topics_choose_chunks_and_what_is_no_bag(spark, tmp_path, recorded):
    messages, want = recorded
    messages = sorted(messages, key=lambda m: (m[1], m[0]))  # each topic's messages together
    write_bag(tmp_path / "b.bag", TOPICS, messages, 50, spoil={k // 50 for k, m in enumerate(messages) if m[1] != "/davis/left/pose"})
    near(bags.read_bag(spark, str(tmp_path / "b.bag"), "pose", "/davis/left/pose").collect(), want["pose"])
    bags.install(spark)
    read = spark.read.format("bag").option("path", str(tmp_path / "b.bag")).option("kind", "pose").load()
    near(read.where("topic = '/davis/left/pose'").collect(), want["pose"])
    assert bags.read_bag(spark, str(tmp_path / "b.bag"), "pose", "/nowhere").collect() == []
    (tmp_path / "c.bag").write_bytes(b"#ROSBAG V1.2\n" + bytes(5000))
    with pytest.raises(Exception, match="no bag of format"):
        bags.read_bag(spark, str(tmp_path / "c.bag"), "imu", "x").collect()
    with pytest.raises(Exception, match="kind must be"):
        spark.read.format("bag").option("path", "x").option("kind", "sound").load()
    with pytest.raises(Exception, match="needs a path"):
        spark.read.format("bag").load().collect()
