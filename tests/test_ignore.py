"""Ignore rules: cases by hand, and random folders against the rules of git itself."""

import random
import shutil
import subprocess

import pytest
from graphloam.sources import ignore, repo

HAND = {
    ".gitignore": "*.log\n!keep.log\n/top.txt\nbuild/\n# no rule\n\n\\#odd\ndocs/**/draft?.md\n**/cache\nlogs/**\n[a-c]x.py\n[!a-c]y.py\ntrail  \n!\n/\nkeep\\ \n",
    "sub/.gitignore": "!a.log\nonly.txt\n",
}
PATHS = {
    "a.log": True, "keep.log": False, "sub/a.log": False, "sub/deep/a.log": False, "sub/b.log": True, "top.txt": True, "sub/top.txt": False, "build/x": True, "sub/build/y/z": True, "build": False,
    "#odd": True, "docs/draft1.md": True, "docs/a/b/draft2.md": True, "docs/draft.md": False, "x/cache": True, "cache/keep.log": True, "logs/a": True, "logs": False, "ax.py": True, "dx.py": False, "ay.py": False, "dy.py": True,
    "trail": True, "sub/only.txt": True, "only.txt": False, "keep ": True, "plain": False, "sub/ax.py": True,
}


def _rules(spark, files):
    return ignore.ignore_rules(spark.createDataFrame(list(files.items()), "path string, text string"))


def _ignored(spark, paths, rules):
    return {r.path for r in ignore.ignored(spark.createDataFrame([(p,) for p in paths], "path string"), rules).collect()}


def test_cases(spark):
    assert _ignored(spark, PATHS, _rules(spark, HAND)) == {p for p, gone in PATHS.items() if gone}


def test_edges(spark):
    rules = _rules(spark, HAND)
    empty = spark.createDataFrame([], "path string, text string")
    assert _ignored(spark, [], rules) == set() and _ignored(spark, ["a.log"], ignore.ignore_rules(empty)) == set()
    assert ignore.ignore_rules(spark.createDataFrame([("x/.gitignore", None), ("y", "")], "path string, text string")).count() == 0
    rows = spark.createDataFrame([("a.log", 1, "x"), ("b", 2, "x"), ("b", 2, "x"), (None, 3, "x")], "path string, rules int, dir string")
    assert sorted((r.path or "", r.rules) for r in ignore.not_ignored(rows, rules).collect()) == [("", 3), ("b", 2), ("b", 2)]


def test_hot_folders(spark, monkeypatch):
    files = HAND | {f"sub/d{i}/.gitignore": "!*.log" for i in range(5)}
    paths = [*PATHS, *[f"sub/d{i}/{j}.log" for i in range(5) for j in range(4)], *[f"sub/e/{j}.log" for j in range(40)]]
    want = _ignored(spark, paths, _rules(spark, files))
    monkeypatch.setattr(ignore, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(ignore, "HOT_FOLDERS", 2)
    assert _ignored(spark, paths, _rules(spark, files)) == want and "sub/e/0.log" in want and "sub/d1/0.log" not in want
    # rows of the folder above most paths stay in the tasks that have them
    rows = spark.range(800, numPartitions=4).selectExpr("if(id % 100 = 99, cast(id as string), 'top') as dir", "id")
    table = spark.createDataFrame([("top", 1), *[(str(i), 2) for i in range(99, 800, 100)]], "dir string, rule int").localCheckpoint()
    met = ignore._by_folder(rows, table, "dir").selectExpr("*", "spark_partition_id() as p")
    assert met.count() == 800 and met.filter("dir = 'top'").select("p").distinct().count() == 4


@pytest.mark.skipif(shutil.which("git") is None, reason="needs git")
def test_as_git(spark, tmp_path):
    rng = random.Random(5)
    names = ["a", "b", "ab", "a.x", "b.x", "c+d", "e&f"]
    pieces = ["*", "a", "b", "?", "*.x", "**", "a*", "[ab]", "[!a]*", "ab", "c+d", "[e]&*", "\\a"]
    pattern = lambda: rng.choice(["", "", "!"]) + rng.choice(["", "", "/"]) + "/".join(rng.choice(pieces) for _ in range(rng.choice([1, 1, 2, 3]))) + rng.choice(["", "", "/"])
    paths, rules, gone = [], [], set()
    for world in range(25):
        root = tmp_path / f"w{world}"
        root.mkdir()
        subprocess.run(["git", "init", "-q"], cwd=root, check=True, timeout=20)
        files = set()
        for _ in range(25):
            folder = root
            parts = [rng.choice(names) for _ in range(rng.choice([1, 2, 3, 4]))]
            for part in parts[:-1]:
                folder = folder / part
                if folder.is_file():
                    break
                folder.mkdir(exist_ok=True)
            else:
                if not (folder / parts[-1]).exists():
                    (folder / parts[-1]).write_text("x")
                    files.add("/".join(parts))
        for at in ["", *rng.sample(names, 2)]:
            if (root / at).is_dir():
                text = "\n".join(pattern() for _ in range(4))
                (root / at / ".gitignore").write_text(text)
                rules.append((f"w{world}/{at}/.gitignore".replace("//", "/"), text))
        said = subprocess.run(["git", "check-ignore", "--no-index", "--stdin", "-z"], cwd=root, input="\0".join(sorted(files)), capture_output=True, text=True, timeout=20, check=False).stdout
        gone |= {f"w{world}/{p}" for p in said.split("\0") if p}
        paths += [f"w{world}/{p}" for p in files]
    assert _ignored(spark, paths, _rules(spark, dict(rules))) == gone and 30 < len(gone) < len(paths)


def test_scan_skips(spark, tmp_path):
    texts = {".gitignore": "*.log\n", "a.py": "x", "a.log": "x", ".hidden/b.py": "x", "sub/.gitignore": "!a.log\n", "sub/a.log": "x", "build/c.py": "x", ".env": "x", "sub/deep/__init__.py": "x", "_priv.py": "x"}
    for path, text in texts.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "loop").symlink_to(tmp_path)
    (tmp_path / "big.py").write_bytes(b"x" * (repo.MAX_BYTES + 1))
    for folder in (str(tmp_path), f"file://{tmp_path}/"):
        walked = {r.path: r.reason for r in repo.scan(spark, folder).collect()}
        assert {p for p, r in walked.items() if r is None} == {p for p in texts if not p.startswith((".hidden", "build"))}
        assert {p: r for p, r in walked.items() if r} == {"loop": "non-file", "big.py": "oversized"}
    by_rules = repo.scan(spark, str(tmp_path), rules=True)
    assert {r.path for r in by_rules.filter("reason is null").collect()} == set(texts) - {"a.log"}
    assert by_rules.filter("reason = 'oversized'").select("content").collect() == [(None,)]


def test_walk_of_many_levels(spark, tmp_path):
    deep = tmp_path.joinpath(*[f"d{i}" for i in range(12)])
    deep.mkdir(parents=True)
    for i in range(40):
        (deep / f"{i}.py").write_text(str(i))
    assert sorted(int(r.content.decode()) for r in repo.scan(spark, str(tmp_path)).collect()) == list(range(40))
    (tmp_path / "none").mkdir()
    assert repo.scan(spark, str(tmp_path / "none")).count() == 0
