"""Texts in pieces of a bounded size, by lines."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from ..fixed import MARKDOWN_BACK_LINES, MARKDOWN_OVERLAP_LINES, MARKDOWN_TAIL_FACTOR, MARKDOWN_TARGET_LINES, MAX_CHUNK_CHARS, SMALL_CHUNK_CHARS

HEADING = re.compile(r"#{1,6}\s")


class Piece(NamedTuple):
    """Lines ``start`` to ``end`` (from 1, inclusive), or a part of one long line."""

    start: int
    end: int
    text: str


def by_lines(lines: Sequence[str], first: int = 1, most: int = MAX_CHUNK_CHARS, overlap: int = 0) -> list[Piece]:
    """Pieces of whole lines that hold at most ``most`` characters, line breaks included; a longer line is cut by itself.

    Each piece but the first starts with the last ``overlap`` lines of the one
    before, if that has more lines.
    """
    out: list[Piece] = []
    held: list[str] = []
    start, size = first, 0

    def close() -> None:
        if held:
            out.append(Piece(start, start + len(held) - 1, "\n".join(held)))

    for number, line in enumerate(lines, first):
        if len(line) > most:
            close()
            out.extend(Piece(number, number, line[i : i + most]) for i in range(0, len(line), most))
            held, size, start = [], 0, number + 1
            continue
        if held and size + len(line) + 1 > most:
            close()
            again = held[-overlap:] if overlap and len(held) > overlap else []
            held, start, size = list(again), number - len(again), sum(len(x) + 1 for x in again)
        held.append(line)
        size += len(line) + 1
    close()
    return out


def merge_small(pieces: Sequence[Piece], most: int = MAX_CHUNK_CHARS, small: int = SMALL_CHUNK_CHARS) -> list[Piece]:
    """Neighbours below ``small`` characters each, one right after the other, as one piece if it is no longer than ``most``."""
    out: list[Piece] = []
    for p in pieces:
        q = out[-1] if out else None
        if q and len(q.text) < small and len(p.text) < small and p.start == q.end + 1 and len(q.text) + 1 + len(p.text) <= most:
            out[-1] = Piece(q.start, p.end, f"{q.text}\n{p.text}")
        else:
            out.append(p)
    return out


def markdown(text: str, most: int = MAX_CHUNK_CHARS) -> list[Piece]:
    """A short text whole; else about sixty lines a piece, cut before a heading near by, a few lines of overlap, a small tail joined to the piece before."""
    lines = text.split("\n")
    if len(text) <= most and len(lines) <= MARKDOWN_TARGET_LINES * 3 // 2:
        return [Piece(1, len(lines), text)]
    out: list[Piece] = []
    at = 0
    while at < len(lines):
        goal = min(at + MARKDOWN_TARGET_LINES, len(lines))
        low = max(goal - MARKDOWN_BACK_LINES, at + MARKDOWN_TARGET_LINES // 3, at + 1)
        cut = next((i for i in range(min(goal, len(lines) - 1), low - 1, -1) if HEADING.match(lines[i])), goal)
        body = "\n".join(lines[at:cut])
        if out and cut < len(lines) and len(body.strip()) < SMALL_CHUNK_CHARS:
            at = cut
            continue
        out.append(Piece(at + 1, cut, body))
        if cut == len(lines):
            break
        at = cut - MARKDOWN_OVERLAP_LINES if cut - MARKDOWN_OVERLAP_LINES > at else cut
    if len(out) > 1 and len(out[-1].text) < SMALL_CHUNK_CHARS:
        p, q = out[-2:]
        if len(p.text) + 1 + len(q.text) <= most * MARKDOWN_TAIL_FACTOR:
            out[-2:] = [Piece(p.start, q.end, f"{p.text}\n{q.text}")]
    return out


def by_statements(lines: Sequence[str], start: int, end: int, statements: Sequence[tuple[int, int]], most: int = MAX_CHUNK_CHARS) -> list[Piece]:
    """A definition of lines ``start`` to ``end`` cut between its statements (first and last lines), as many as fit in each piece."""
    cuts = [start]
    for n, (first, last) in enumerate(statements):
        if n and first > cuts[-1] and sum(len(x) + 1 for x in lines[cuts[-1] - 1 : last]) - 1 > most:
            cuts.append(first)
    return [Piece(a, b, "\n".join(lines[a - 1 : b])) for a, b in zip(cuts, [c - 1 for c in cuts[1:]] + [end], strict=True) if any(x.strip() for x in lines[a - 1 : b])]
