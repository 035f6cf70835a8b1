"""Line dedup in plain Python, a text at a time."""

from __future__ import annotations

import re

WORD = r"(?:[\u3000-\ud7ff]|[^\x20\x09-\x0D\u3000-\ud7ff]+)"


def plain_lines(text, width=8):
    """Lists of (row, words, raw) in order."""
    out = []
    for r, row in enumerate((text or "").split("\n")):
        parts = re.findall(WORD + r"[\x20\x09-\x0D]*", row)
        words = [re.match(WORD, x)[0] for x in parts]
        keys = [w.encode()[:8].ljust(8, b"\0") for w in words]
        ends = {max(range(i, i + width), key=lambda j: (keys[j], j)) for i in range(len(words) - width + 1)} | {len(words) - 1}
        begin = 0
        for e in sorted(ends) if words else []:
            out.append((r, words[begin : e + 1], "".join(parts[begin : e + 1])))
            begin = e + 1
    return out


def plain_windows(lines, window=3):
    held = [" ".join(w) for _, w, _ in lines]
    n = min(window, len(held))
    return [(i, "\n".join(held[i : i + n])) for i in range(len(held) - n + 1 if n else 0)]


def plain_cut(text, lines, starts, least=20, window=3):
    """The text without the windows that begin at ``starts``, and how many lines went."""
    gone = sorted({j for i in starts for j in range(i, min(i + window, len(lines)))})
    runs = []
    for j in gone:
        if runs and runs[-1][-1] == j - 1:
            runs[-1].append(j)
        else:
            runs.append([j])
    gone = {j for run in runs if sum(len(lines[j][1]) for j in run) >= least for j in run}
    if not gone:
        return text, 0
    if len(gone) == len(lines):
        return "", len(gone)
    out = []
    for r, row in enumerate(text.split("\n")):
        own = [j for j, x in enumerate(lines) if x[0] == r]
        if not own or any(j not in gone for j in own):
            out.append(row if not own else re.match(r"[\x20\x09-\x0D]*", row)[0] + "".join(lines[j][2] for j in own if j not in gone))
    return "\n".join(out), len(gone)
