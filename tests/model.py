"""Slow frame-by-frame models, written from the definitions, that the operators are compared with."""

import numpy as np


def kinematics(points, fps, window=15, order=3, max_missed=5):
    """points: {(track, frame): (x, y)} -> {(track, frame): (vx, vy, ax, ay, warm)}"""
    out = {}
    at = np.arange(1 - window, 1, dtype=float)
    fit = np.linalg.pinv(np.vander(at, order + 1, increasing=True))
    for track in {t for t, _ in points}:
        line, last = [], None
        for frame in sorted(f for t, f in points if t == track):
            x, y = points[track, frame]
            if last is not None and frame - last - 1 > max_missed:
                line = []
            elif last is not None:
                gap = frame - last - 1
                lx, ly = line[-1]
                line += [(lx + i / (gap + 1) * (x - lx), ly + i / (gap + 1) * (y - ly)) for i in range(1, gap + 1)]
            line.append((x, y))
            last = frame
            line = line[-window:]
            if len(line) == window:
                c = fit @ np.array(line)
                out[track, frame] = (*(c[1] * fps), *(2 * c[2] * fps * fps), True)
            elif len(line) > 1:
                out[track, frame] = ((x - line[-2][0]) * fps, (y - line[-2][1]) * fps, 0.0, 0.0, False)
            else:
                out[track, frame] = (0.0, 0.0, 0.0, 0.0, False)
    return out


def inside(p, polygon):
    flag = False
    for i, (x, y) in enumerate(polygon):
        ox, oy = polygon[i - 1]
        if (y > p[1]) != (oy > p[1]) and p[0] < (ox - x) * (p[1] - y) / (oy - y) + x:
            flag = not flag
    return flag


def crossings(path, polygon, gates):
    """path: [(frame, x, y)] of one vehicle; gates: [(name, p1, p2)] -> [(frame, gate, direction, confidence)]"""
    events, before, was, entered = [], None, False, False
    for frame, x, y in path:
        now = inside((x, y), polygon) if polygon else False
        found = []
        if before is not None:
            dx, dy = x - before[0], y - before[1]
            for name, (ax, ay), (bx, by) in gates:
                gx, gy = bx - ax, by - ay
                cross = dx * gy - dy * gx
                if abs(cross) < 1e-10:
                    continue
                t = ((ax - before[0]) * gy - (ay - before[1]) * gx) / cross
                u = ((ax - before[0]) * dy - (ay - before[1]) * dx) / cross
                if 0 <= t <= 1 and 0 <= u <= 1:
                    found.append((frame, name, "enter" if dx * -gy + dy * gx >= 0 else "exit", "confirmed"))
        if not found and gates:
            mids = [((x - (a[0] + b[0]) / 2) ** 2 + (y - (a[1] + b[1]) / 2) ** 2, i) for i, (_, a, b) in enumerate(gates)]
            near = gates[min(mids)[1]][0]
            if now and not was and (before is None or not entered):
                found.append((frame, near, "enter", "estimated"))
            elif before is not None and was and not now:
                found.append((frame, near, "exit", "estimated"))
        entered = entered or any(e[2] == "enter" for e in found)
        events += found
        before, was = (x, y), now
    return events


def cooldown(times, seconds):
    fired, last = [], None
    for t in sorted(times):
        if last is None or t - last >= seconds:
            fired.append(t)
            last = t
    return fired
