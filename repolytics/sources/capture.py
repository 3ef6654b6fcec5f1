"""What only the version-control tool can tell, captured as text files that Spark then reads."""

from __future__ import annotations

import os
import subprocess
import tarfile
import uuid

LOG_FORMAT = "%x1e%H%x1f%an%x1f%ae%x1f%aI%x1f%P"


def git(root: str, *arguments: str, timeout: float = 120) -> bytes:
    """The output of a git command; empty where there is no repository or no commit."""
    done = subprocess.run(["git", "-C", root, *arguments], capture_output=True, timeout=timeout)
    return done.stdout if done.returncode == 0 else b""


def _kept(folder: str, name: str, data: bytes) -> str:
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{name}-{uuid.uuid4().hex}.txt")
    with open(path, "wb") as file:
        file.write(data)
    return path


def log(root: str, folder: str, since: str | None = None, merges: bool = False, timeout: float = 120) -> str:
    """Write the log with line counts to a file in folder; its path."""
    options = [*([] if merges else ["--no-merges"]), *([f"--since={since}"] if since else [])]
    return _kept(folder, "log", git(root, "log", "--numstat", f"--format={LOG_FORMAT}", *options, timeout=timeout))


def pending(root: str, folder: str) -> tuple[str, str]:
    """Files of the names that differ from the last commit and of the untracked ones."""
    return _kept(folder, "changed", git(root, "diff", "--name-only", "HEAD")), _kept(folder, "untracked", git(root, "ls-files", "--others", "--exclude-standard"))


def head(root: str) -> str:
    return git(root, "rev-parse", "HEAD").decode().strip()


def revision(root: str, ref: str, folder: str) -> str:
    """Extract the tree of a revision to a new folder; what would leave it is refused."""
    archive = _kept(folder, "tree", git(root, "archive", "--format=tar", ref))
    if not os.path.getsize(archive):
        raise ValueError(f"{ref!r} is no revision of {root}")
    target = os.path.join(folder, f"tree-{uuid.uuid4().hex}")
    os.makedirs(target)
    with tarfile.open(archive) as tar:
        tar.extractall(target, filter="data")
    os.remove(archive)
    return target
