"""External anchoring of chain.json. Witnesses need a network; this is their interface, and a local one for tests."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path
from typing import Any, Protocol

from tallyline.plans import files, receipts


class Witness(Protocol):
    def attest(self, digest: str) -> dict[str, Any]: ...

    def check(self, digest: str, proof: dict[str, Any]) -> bool: ...


class LogWitness:
    """A witness on this machine: a file that only grows, in which each line names a digest and seals the lines before it."""

    def __init__(self, path: str | Path):
        self.path = Path(path)

    def _lines(self) -> list[str]:
        return self.path.read_text(encoding="utf-8").splitlines() if self.path.exists() else []

    @staticmethod
    def _seal(lines: list[str]) -> str:
        return hashlib.sha256("\n".join(lines).encode()).hexdigest()

    def attest(self, digest: str) -> dict[str, Any]:
        lines = self._lines()
        line = f"{receipts.now_iso()} {digest} {self._seal(lines)}"
        with self.path.open("a", encoding="utf-8") as file:
            file.write(line + "\n")
        return {"line": len(lines), "text": line}

    def check(self, digest: str, proof: dict[str, Any]) -> bool:
        if not self.path.exists():
            raise AnchorUnavailable(f"{self.path} isn't there")
        lines, at = self._lines(), proof.get("line")
        held = lines[at].split(" ") if type(at) is int and 0 <= at < len(lines) else []
        return len(held) == 3 and lines[at] == proof.get("text") and held[1] == digest and held[2] == self._seal(lines[:at])


class AnchorUnavailable(RuntimeError):
    """No witness can be reached."""


def _digest(folder: str | Path) -> str:
    return hashlib.sha256((Path(folder) / receipts.CHAIN).read_bytes()).hexdigest()


def anchor(folder: str | Path, witness: Witness) -> Path:
    return files.write_text(Path(folder) / "chain.json.anchor", files.text_of({"digest": _digest(folder), "proof": witness.attest(_digest(folder))}), overwrite=True)


def fold(result: receipts.ChainResult, folder: str | Path, witness: Witness | None) -> receipts.ChainResult:
    """Adds the anchor's finding: red for another digest or a failed proof, a caveat where it can't be checked."""
    path = Path(folder) / "chain.json.anchor"
    if not path.exists():
        return result
    held = json.loads(path.read_text())
    if held.get("digest") != _digest(folder):
        return result.add("anchor", text="chain.json isn't the anchored one")
    try:
        if witness is None:
            raise AnchorUnavailable("no witness is configured")
        if not witness.check(held["digest"], held["proof"]):
            return result.add("anchor", text="the witness doesn't confirm the proof")
    except AnchorUnavailable as e:
        result.add("unanchored", text=str(e))
    return result
