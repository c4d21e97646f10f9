"""Version control as a source: change lists, contents at a commit, the base of a change, and the developer's files.

Git itself runs on the driver, over one repository; what it prints becomes DataFrames that all operators read.
"""

from __future__ import annotations

import os
import subprocess
import zlib

from pyspark.sql import DataFrame, SparkSession

from tremor.operators import changes

# --- fixed values: kinds of change that are listed, branches that stand for a remote, and recent release branches that are tried ---
LISTED, ALIVE = "--diff-filter=ACMRTD", "--diff-filter=ACMRT"
FALLBACKS = ("main", "master", "develop")
RELEASES, RECENT = "sprint/*", 5
NO_BASE = "none"


def git(args: list[str], cwd: str) -> tuple[int, str]:
    """(code, output) of a git command; 127 if git can't be run."""
    try:
        done = subprocess.run(["git", *args], cwd=cwd, capture_output=True)
    except OSError:
        return 127, ""
    return done.returncode, done.stdout.decode("utf-8", "replace")


def succeeds(args: list[str], cwd: str) -> bool:
    return git(args, cwd)[0] == 0


def output(args: list[str], cwd: str, default: str = "") -> str:
    """What a command prints, without white space at its end, or default if it fails."""
    code, text = git(args, cwd)
    return text.rstrip() if code == 0 else default


def lines(args: list[str], cwd: str) -> list[str]:
    """Lines that a command prints; none if it fails."""
    return [x for x in output(args, cwd).split("\n") if x]


def tokens(args: list[str], cwd: str) -> list[str]:
    """What stands between NUL characters; none if the command fails."""
    code, text = git(args, cwd)
    return [t for t in text.split("\0") if t] if code == 0 else []


def token_stream(spark: SparkSession, args: list[str], cwd: str) -> DataFrame:
    """(pos, token) of NUL-separated output."""
    return spark.createDataFrame(list(enumerate(tokens(args, cwd))), "pos int, token string")


def change_list(spark: SparkSession, root: str, anchor: str | None = None, staged: bool = False, from_ref: str | None = None, to_ref: str | None = None) -> DataFrame:
    """path, status, old_path, ext of what changed: staged; since the anchor; between two commits; else staged, since the last commit and in the tree, the first that names a path."""
    if staged:
        tails = [["--cached"]]
    elif anchor:
        tails = [[anchor, "HEAD"]]
    elif from_ref and to_ref:
        tails = [[from_ref, to_ref]]
    else:
        tails = [["--cached"], ["HEAD"], []]
    found = [changes.parse_name_status(token_stream(spark, ["diff", "--name-status", "-z", LISTED, "--find-renames", *tail], root)).select("path", "status", "old_path") for tail in tails]
    return changes.merge_change_lists(*found)


def blob(root: str, ref: str, path: str) -> str:
    """Text of a path at a commit, empty if it is not there."""
    return git(["show", f"{ref}:{path}"], root)[1] if succeeds(["cat-file", "-e", f"{ref}:{path}"], root) else ""


def snapshot(spark: SparkSession, root: str, ref: str, only: list[str] | None = None) -> DataFrame:
    """(path, text) of the files of a commit, or of those named."""
    listed = tokens(["ls-tree", "-r", "-z", "--name-only", ref], root)
    kept = listed if only is None else [p for p in listed if p in set(only)]
    return spark.createDataFrame([(p, blob(root, ref, p)) for p in kept], "path string, text string")


def remotes(root: str) -> list[str]:
    """Names of remotes: upstream, origin, then the rest by name."""
    names = set(lines(["remote"], root))
    names |= {p[2] for p in (r.split("/") for r in lines(["for-each-ref", "--format=%(refname)", "refs/remotes/"], root)) if len(p) >= 3}
    return sorted(names, key=lambda n: ({"upstream": 0, "origin": 1}.get(n, 2), n))


def base_candidates(root: str, remote: str, limit: int = RECENT) -> list[tuple[str, int]]:
    """(ref, files in which it differs from HEAD) of the branches that a change may be based on, as far as they are there.

    Of upstream the main branch and its most recent release branches; once one does not differ, no more are asked.
    """
    found = []
    recent = lines(["for-each-ref", "--sort=-committerdate", "--format=%(refname)", f"refs/remotes/{remote}/{RELEASES}"], root)[:limit]
    for ref in [f"refs/remotes/{remote}/master", *recent]:
        if succeeds(["rev-parse", "--verify", ref], root):
            found.append((ref, len(tokens(["diff", "--name-only", "-z", ALIVE, ref, "HEAD"], root))))
            if not found[-1][1]:
                break
    return found


def change_base(spark: SparkSession, root: str, limit: int = RECENT) -> str | None:
    """The remote branch that a change is based on: of the first remote that has one, upstream's closest, else a remote's head or main branch."""
    for remote in remotes(root):
        if remote == "upstream":
            found = [(ref, k, n) for k, (ref, n) in enumerate(base_candidates(root, remote, limit))]
            if found:
                return changes.change_base(spark.createDataFrame(found, "name string, ord int, differing int")).first()["name"]
            continue
        head = output(["symbolic-ref", "--short", f"refs/remotes/{remote}/HEAD"], root)
        for ref in ([f"refs/remotes/{head}"] if head.startswith(f"{remote}/") else []) + [f"refs/remotes/{remote}/{b}" for b in FALLBACKS]:
            if succeeds(["rev-parse", "--verify", ref], root):
                return ref
    return None


def cache_key(gitdir: str, from_ref: str, to_ref: str) -> str:
    return f"{zlib.crc32(' '.join((gitdir, from_ref, to_ref)).encode()):08x}"


class Scope:
    """What a developer's range of commits covers; answers are kept in small files named by the commits, if a folder is given."""

    def __init__(self, spark: SparkSession, root: str, folder: str | None = None):
        self.spark, self.root, self.folder = spark, root, folder

    def _commit(self, ref: str) -> str:
        return output(["rev-parse", "--verify", "--quiet", f"{ref}^{{commit}}"], self.root) or ref

    def _file(self, kind: str, from_ref: str | None, to_ref: str | None) -> str | None:
        if not (self.folder and from_ref and to_ref):
            return None
        return os.path.join(self.folder, f"{kind}.{cache_key(output(['rev-parse', '--absolute-git-dir'], self.root), self._commit(from_ref), self._commit(to_ref))}")

    def _kept(self, at: str | None, find) -> list[str]:
        """Lines of the file, or what find gives, which is then written; a folder that can't be written is no fault."""
        if at is None:
            return find()
        try:
            with open(at, encoding="utf-8") as f:
                return [x for x in f.read().split("\n") if x]
        except (OSError, ValueError):
            pass
        found = find()
        try:
            os.makedirs(self.folder, exist_ok=True)
            with open(f"{at}.{os.getpid()}", "w", encoding="utf-8") as f:
                f.write("".join(f"{x}\n" for x in found))
            os.replace(f"{at}.{os.getpid()}", at)
        except OSError:
            pass
        return found

    def anchor(self, from_ref: str | None = None, to_ref: str | None = None) -> str | None:
        """The base of the change; that there is none is kept too."""
        found = self._kept(self._file("anchor", from_ref, to_ref), lambda: [change_base(self.spark, self.root) or NO_BASE])
        return None if not found or found[0] == NO_BASE else found[0]

    def files(self, anchor: str | None = None, from_ref: str | None = None, to_ref: str | None = None) -> DataFrame:
        """(path) of the developer's files: since the anchor; since the commits parted; else all that differs from the last commit."""
        listed = lambda *tail: tokens(["diff", *tail[:1], "--name-only", "-z", ALIVE, *tail[1:]] if tail[:1] == ("--cached",) else ["diff", "--name-only", "-z", ALIVE, *tail], self.root)

        def find() -> list[str]:
            if anchor:
                return listed(anchor, "HEAD")
            if from_ref and to_ref:
                return listed(f"{from_ref}...{to_ref}")
            return sorted({*listed("HEAD"), *listed("--cached"), *listed()})

        return self.spark.createDataFrame([(p,) for p in self._kept(self._file("files", from_ref, to_ref), find)], "path string")

    def changed_lines(self, anchor: str | None = None, from_ref: str | None = None, to_ref: str | None = None) -> DataFrame:
        """(path, line) of changed lines on the new side of tracked files."""
        tails = [[anchor, "HEAD"]] if anchor else [[f"{from_ref}...{to_ref}"]] if from_ref and to_ref else [["HEAD"], ["--cached"], []]
        rows = []
        for tail in tails:
            path = None
            for line in output(["diff", "--unified=0", "--no-color", "--no-ext-diff", *tail], self.root).split("\n"):
                if line.startswith("+++ "):
                    path = line[6:] if line.startswith("+++ b/") else None
                elif line.startswith("@@ ") and path:
                    rows.append((path, line))
        hunks = changes.parse_hunks(self.spark.createDataFrame(rows, "path string, text string"))
        return changes.hunk_lines(hunks)
