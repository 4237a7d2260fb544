import hashlib
import os

from lectern.sinks.deliveries import FolderStore, deliver, remove

PLAN = "target string, content binary"


class Shaky(FolderStore):
    """A store that fails as often as a target's name says, counting in files that all tasks see."""

    def put(self, target, content):
        n = f"{self.root}.tries.{target.replace('/', '_')}"
        with open(n, "ab") as f:
            f.write(b"x")
        if os.path.getsize(n) <= int(target[0]):
            raise OSError("away")
        super().put(target, content)


def receipts(df):
    return {r.target: (r.status, r.attempts) for r in df.collect()}


def test_attempts_and_repeats(spark, tmp_path):
    store = Shaky(str(tmp_path / "s"))
    plan = spark.createDataFrame([("0/a", b"a"), ("2/b", b"b" * 3), ("3/c", b"c"), ("9/d", b"")], PLAN)
    got = deliver(plan, store)
    assert receipts(got) == {"0/a": ("OK", 1), "2/b": ("OK", 3), "3/c": ("FAIL:away", 3), "9/d": ("FAIL:away", 3)}
    assert receipts(got) == receipts(got)  # looked at again, nothing is sent again
    assert os.path.getsize(f"{store.root}.tries.2_b") == 3
    # a run again sends what failed only
    assert receipts(deliver(plan, store)) == {"0/a": ("SKIP:there", 1), "2/b": ("SKIP:there", 1), "3/c": ("OK", 1), "9/d": ("FAIL:away", 3)}
    with open(f"{store.root}/2/b", "rb") as f:
        assert f.read() == b"bbb"
    assert not [x for _, _, fs in os.walk(store.root) for x in fs if x.endswith(".part")]


def test_odd_plans(spark, tmp_path):
    store = FolderStore(str(tmp_path / "s"))
    rows = [("same", b"x"), ("same", b"x"), ("torn", b"1"), ("torn", b"2"), ("none", None), ("half", None), ("half", b"h"), (None, b"?")]
    got = {r.target: r for r in deliver(spark.createDataFrame(rows, PLAN), store).collect()}
    assert {t: r.status for t, r in got.items()} == {
        "same": "OK", "torn": "FAIL:more than one content", "half": "FAIL:more than one content", "none": "FAIL:no content",
    }
    assert got["same"].sha256 == hashlib.sha256(b"x").hexdigest() and got["same"].bytes == 1
    assert deliver(spark.createDataFrame([], PLAN), store).count() == 0
    # another content takes the place of the first
    assert receipts(deliver(spark.createDataFrame([("same", b"y")], PLAN), store)) == {"same": ("OK", 1)}
    assert store.digest("same") == hashlib.sha256(b"y").hexdigest()


def test_remove(spark, tmp_path):
    store = FolderStore(str(tmp_path / "s"))
    store.put("p/a", b"1")
    store.put("p/b", b"2")
    got = receipts(remove(spark.createDataFrame([("p/a",), ("p/a",), ("p/gone",), (None,)], "path string"), store))
    assert got == {"p/a": ("OK", 1), "p/gone": ("OK", 1)}
    assert store.digest("p/a") is None and store.digest("p/b") is not None
