"""Git hooks that bring a store up to date."""

from __future__ import annotations

import os
import stat

MARK = "# graphloom hook"


def script(root: str, store: str) -> str:
    """A hook that updates the store of a project and never stops git."""
    quoted = lambda x: "'" + x.replace("'", "'\\''") + "'"
    return f"#!/bin/sh\n{MARK}\npython -m graphloom.plans.shell update {quoted(store)} {quoted(root)} >/dev/null 2>&1 || true\n"


def install_hooks(git_dir: str, root: str, store: str, force: bool = False) -> dict[str, str]:
    """Writes the hooks pre-commit and post-checkout: what happened to each.

    An own hook is replaced (``updated``). Another one is kept beside it as
    ``<name>.backup``, which the new hook calls first (``wrapped``), or replaced with
    force (``replaced``). Files are written whole and then renamed. A path with ..
    segments is refused.
    """
    if ".." in git_dir.split(os.sep):
        raise ValueError("the git directory must not contain '..'")
    folder, told = os.path.join(git_dir, "hooks"), {}
    os.makedirs(folder, exist_ok=True)
    for name in ("pre-commit", "post-checkout"):
        path, text = os.path.join(folder, name), script(root, store)
        told[name] = "created"
        if os.path.exists(path):
            with open(path, encoding="utf-8", errors="replace") as f:
                old = f.read()
            if MARK in old:
                told[name] = "updated"
            elif force:
                told[name] = "replaced"
            else:
                os.replace(path, path + ".backup")
                told[name] = "wrapped"
        if os.path.exists(path + ".backup"):
            text = text.replace(f"{MARK}\n", f'{MARK}\n"$(dirname "$0")/{name}.backup" "$@" || exit $?\n')
        draft = f"{path}.{os.getpid()}.tmp"
        with open(draft, "w", encoding="utf-8") as f:
            f.write(text)
        os.chmod(draft, os.stat(draft).st_mode | stat.S_IXUSR | stat.S_IXGRP | stat.S_IXOTH)
        os.replace(draft, path)
    return told
