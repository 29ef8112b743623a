"""Changed paths of a working tree from version control, on the driver."""
from __future__ import annotations

import subprocess

from corposcope.errors import WalkError
from corposcope.operators.indexing import parse_change_text


def _git(root: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=120)
    if done.returncode:
        raise WalkError(done.stderr.strip() or f"git {args[0]} failed")
    return done.stdout


def head(root: str) -> str:
    return _git(root, "rev-parse", "HEAD").strip()


def head_or_none(root: str) -> str | None:
    """The head commit if ``root`` lies below version control and has one."""
    try:
        done = subprocess.run(["git", "-C", root, "rev-parse", "--verify", "-q", "HEAD"], capture_output=True, text=True, timeout=120)
    except OSError:
        return None
    return done.stdout.strip() or None if not done.returncode else None


def is_ancestor(root: str, commit: str) -> bool:
    """Whether a commit is in the history of the current head; an unknown commit is not."""
    return subprocess.run(["git", "-C", root, "merge-base", "--is-ancestor", commit, "HEAD"], capture_output=True).returncode == 0


def changes(root: str, since: str | None) -> list[tuple[int, str, str]]:
    """(ordinal, status, path) of committed, staged, unstaged and untracked changes, in that order.

    Paths are relative to ``root``.  Later ordinals win (see indexing.union_change_lists).
    """
    texts = [_git(root, "diff", "--relative", "--name-status", f"{since}..HEAD") if since else "",
             _git(root, "diff", "--relative", "--name-status", "--cached"), _git(root, "diff", "--relative", "--name-status")]
    out = [(i, "D" if s == "D" else "M", p) for i, t in enumerate(texts) for s, p in parse_change_text(t)]
    return out + [(3, "A", p) for p in _git(root, "ls-files", "--others", "--exclude-standard").splitlines()]


def ignored(root: str) -> tuple[str, ...]:
    """SQL LIKE patterns of the ignored files and directories, for ``corpus.walk``."""
    rows = _git(root, "ls-files", "--others", "--ignored", "--exclude-standard", "--directory").splitlines()
    mark = lambda p: p.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return tuple(f"{mark(root.rstrip('/') + '/' + p)}{'%' if p.endswith('/') else ''}" for p in rows)
