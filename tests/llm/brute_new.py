"""Plain Python answers for repair, token counts and hard negatives."""

import math
import re
import zlib
from functools import lru_cache

from brute import sha


def damage(rows):
    """Rows (conv, turn, role, text) after what their checksums do to them."""
    out = []
    for conv, turn, role, text in rows:
        name = ":".join(" " if v is None else str(v) for v in (conv, turn))
        role, text = (" " if v is None else v for v in (role, text))
        fate = zlib.crc32(name.encode()) % 20
        if fate == 0:
            continue
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if fate == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        shown = re.sub(r"[\x20\x09-\x0D]", "", text)
        if not shown:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if shown[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(initials, found):
    """Least cost and edits over all ways to reach a legal sequence of roles, from the last row to the first."""

    @lru_cache(None)
    def rest(i, last, inserted):
        best = []
        if i == len(initials) and last in ("", "a"):
            best.append((0, ""))
        for role in "ua":
            if inserted < 3 and (last + role in ("u", "su", "ua", "au")):
                best.append(plus((5, "I"), rest(i, role, inserted + 1)))
        if i < len(initials):
            best.append(plus((2, "D"), rest(i + 1, last, 0)))
            if found[i] not in ("blank", "duplicate"):
                more = 5 if found[i] == "truncated" else 0
                for role in "sua":
                    if last + role not in ("s", "u", "su", "ua", "au"):
                        continue
                    if initials[i] == role:
                        best.append(plus((more, "K"), rest(i + 1, role, 0)))
                    if role != "s":
                        best.append(plus((1 + more, "R"), rest(i + 1, role, 0)))
        return min((b for b in best if b), default=None)

    def plus(a, b):
        return b and (a[0] + b[0], a[1] + b[1])

    return rest(0, "", 0)


def repaired(rows, edits):
    out, last, i = [], "", 0
    for e in edits:
        row = rows[i] if e != "I" else None
        i += e != "I"
        if e == "D":
            continue
        role = row[2] if e == "K" else "assistant" if last == "u" else "user"
        last = role[:1]
        out.append(f"{role}:{row[3] if row else ''}")
    return "\n".join(out)


def repair(rows, every):
    """{conv: summary} of damaged rows; ``every`` lists the conversations."""
    out = {}
    for conv in every:
        mine = [r for r in rows if r[0] == conv]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        if not mine:
            out[conv] = (0, 0, 0, 0, 0, 0, "", sha(""))
            continue
        found, initials = faults(mine), [r[2][:1] for r in mine]
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, edits = cheapest(tuple(initials), tuple(found))
        counts = [found.count(f) for f in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *counts, illegal, cost, edits, sha(repaired(mine, edits)))
    return out


def hard_negatives(rows, is_anchor, scale=256, positives=5, negatives=5, share=80):
    usable = {}
    for key, vector, label in rows:
        if key is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        usable.setdefault(key, []).append((label, vector))
    usable = {k: min(v) for k, v in usable.items()}
    whole = {k: (label, [math.floor(scale * x) for x in v]) for k, (label, v) in usable.items()}
    out = []
    for a, (label, v) in whole.items():
        if not is_anchor(a):
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), k, m) for k, (m, w) in whole.items() if k != a and len(w) == len(v)]
        scored.sort()
        for p, pk, _ in [s for s in scored if s[2] == label][:positives]:
            under = [s for s in scored if s[2] != label and share * -p <= 100 * -s[0] <= 100 * -p][:negatives]
            out += [(a, pk, i, nk, -p, -n) for i, (n, nk, _) in enumerate(under, 1)]
    return sorted(out)
