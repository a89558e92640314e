import csv
import hashlib
import os
import re

from pyspark.sql import functions as F

from discursa import config
from discursa.functions import privacy as pv
from discursa.operators import release
from discursa.sources import ragged_csv as rc

SALT = b"\x00\xffsalt"


def h(name):
    return hashlib.sha256(SALT + name.strip().lower().encode()).hexdigest()[:12]


def column(spark, rows, fn):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v string")
    return [r[0] for r in df.select(fn(F.col("v")), "i").orderBy("i").collect()]


def test_pseudonyms(spark):
    got = column(spark, ["Ann", " ann ", "NONE", "", " - ", "null", None, "Ünal"], lambda c: pv.pseudonym(c, SALT))
    assert got == [h("ann"), h("ann"), "NONE", "", " - ", "null", None, h("ünal")]


def test_masking(spark):
    rows = ["hi @Bob.", "@a_b and @c.d.e..", "mail x@y.z!", "none", "", None, "@", "@@bob", "@" + "x" * 40, "é@bob"]

    def plain(t):
        if not t or "@" not in t:
            return t
        return re.sub(config.MENTION_PATTERN, lambda m: "@" + h(m.group(1).rstrip(".")), t)

    assert column(spark, rows, lambda c: pv.mask_mentions(c, SALT)) == [plain(r) for r in rows]


def test_salt_file(tmp_path):
    path = str(tmp_path / "salt")
    assert pv.load_salt(path) == pv.load_salt(path) and len(pv.load_salt(path)) == 16
    assert os.stat(path).st_mode & 0o077 == 0


RAW = """type,parent_id,username,timestamp,likes,komentar
PARENT,NONE,willow,2/11/2023, 06.01.59,88,"frost, @Yarrow."
REPLY,willow,yarrow,3/11/2023, 19.20.21,13,thaw

x
"""


def test_raw_copy_keeps_the_shape(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "T.csv").write_text(RAW, encoding="utf-8")
    masked = release.mask_records(rc.read_records(spark, str(tmp_path / "in")), SALT)
    out = str(tmp_path / "out")
    release.write_raw(masked, "type,parent_id,username,timestamp,likes,komentar", out, per_file=100)
    (part,) = [os.path.join(d, f) for d, _, fs in os.walk(out) for f in fs if f.endswith(".txt")]
    with open(part, newline="", encoding="utf-8") as handle:
        rows = list(csv.reader(handle))
    assert rows[1] == ["PARENT", "NONE", h("willow"), "2/11/2023", " 06.01.59", "88", f"frost, @{h('yarrow')}"]
    assert rows[2] == ["REPLY", h("willow"), h("yarrow"), "3/11/2023", " 19.20.21", "13", "thaw"]
    assert rows[3] == [] and rows[4] == ["x"]


def test_sliced_raw_copy_reads_back(spark, tmp_path):
    """Numbers, posts and each file's own header survive slices smaller than a post."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "T #1%.csv").write_text(RAW, encoding="utf-8")
    plain = "username,timestamp,likes,komentar\n" + "".join(f'u{i},8/3/2024, 05.12.33,{i},"a\n{i}"\n' for i in range(23))
    (tmp_path / "in" / "U.csv").write_text(plain, encoding="utf-8")
    records = rc.read_records(spark, str(tmp_path / "in"))
    out = str(tmp_path / "out")
    release.write_raw(release.mask_records(records, SALT), rc.read_headers(spark, str(tmp_path / "in")), out, per_file=5)
    back = rc.read_records(spark, out)
    masked = release.mask_records(records, SALT)
    keys = ["post", "record_no", "fields", "n_header", "threaded"]

    def key(r):
        return (r.post, r.record_no)

    assert sorted(back.select(keys).collect(), key=key) == sorted(masked.select(keys).collect(), key=key)
    assert back.count() == 27


def test_label_release(spark):
    df = spark.createDataFrame([("p#1", "t @bob", None), ("q#2", "t", "see @bob..")], "id string, clean string, note string")
    rows = {r.id: r for r in release.release_labels(df, SALT).collect()}
    assert rows["p#1"].note == "" and rows["q#2"].note == f"see @{h('bob')}" and rows["q#2"].post == "q"


def test_mention_graph_links_authors(spark):
    df = spark.createDataFrame([("Ann", "@Bob. @bob @zed"), ("bob", "no"), ("cy", "@ann")], "username string, text string")
    got = {(r.author, r.mentioned, r.n) for r in release.mention_graph(df, SALT).collect()}
    assert got == {(h("ann"), h("bob"), 2), (h("cy"), h("ann"), 1)}


def test_manifest_file(spark, tmp_path):
    import json

    layers = release.manifest({"a": spark.range(3), "b": spark.range(5)})
    release.write_manifest(spark, layers, str(tmp_path / "m"), title="t")
    assert json.loads(spark.read.text(str(tmp_path / "m")).collect()[0][0]) == {"title": "t", "rows": {"a": 3, "b": 5}}


def test_rows_behind_a_stray_quote_are_masked(spark, tmp_path):
    rows = ['ann,8/3/2024, 05.12.33,1,"cut off', *[f"name{i},8/3/2024, 05.12.33,{i},text {i}" for i in range(12)], 'zoe,8/3/2024, 05.12.33,1,"hi, @ann"']
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "P.csv").write_text("username,timestamp,likes,komentar\n" + "\n".join(rows) + "\n", encoding="utf-8")
    records = rc.read_records(spark, str(tmp_path / "in"), resync=True)
    out = str(tmp_path / "out")
    release.write_raw(release.mask_records(records, SALT), "username,timestamp,likes,komentar", out)
    lines = [line for f in sorted((tmp_path / "out").rglob("*.txt")) for line in f.read_text(encoding="utf-8").splitlines()]
    assert len(lines) == 15 and not any(x in line for line in lines for x in ("ann,", "@ann", "name", "zoe") if line != lines[0])
    assert [line.rpartition(",")[2] for line in lines[1:-1]] == ["cut off", *[f"text {i}" for i in range(12)]]
    good, bad = rc.read_comments(spark, f"{out}/*/*/*.txt")
    assert good.count() == 14 and bad.count() == 0
