"""The SQL each registered query is checked against, over the given tables.

Written from the definitions with whole-key windows and plain joins, the straightforward way,
not the way the operators work. Shared steps are named common table expressions; ``sql`` puts
the needed ones in front of a query.
"""

# Cubic least-squares derivative at the last of 15 samples, oldest tap first.
VELOCITY = [-46319, 2158, 29047, 38324, 33965, 19946, 243, -21168, -40311, -53210, -55889, -44372, -14683, 37154, 115115]
VELOCITY_DIV = 334152
ACCEL = [-3640, -169, 1886, 2770, 2728, 2005, 846, -504, -1800, -2797, -3250, -2914, -1544, 1105, 5278]
ACCEL_DIV = 55692


def _fir(axis, taps, div, times):
    parts = [f"lag({axis}, {14 - i}) over w * {t}::DOUBLE" for i, t in enumerate(taps[:-1])]
    parts.append(f"{axis} * {taps[-1]}::DOUBLE")
    return f"({' + '.join(parts)}) / {div}::DOUBLE" + " * 10::DOUBLE" * times


def _pip(px, py):
    """Even-odd test against the zone with left ``l`` and right ``r``; flat edges never straddle."""
    edges = [("r", 180, "r + 80", 400), ("r + 80", 400, "r", 620), ("l", 620, "l", 180)]
    terms = [
        f"(case when ({yb}::DOUBLE > {py}) <> ({ya}::DOUBLE > {py}) and {px} < (({xa}) - ({xb})) * ({py} - {yb}::DOUBLE)"
        f" / ({ya - yb})::DOUBLE + ({xb}) then 1 else 0 end)"
        for xa, ya, xb, yb in edges
    ]
    return f"(({' + '.join(terms)}) % 2 = 1)"


STATE = """case when speed < 0.5::DOUBLE then 'STOPPED' when signed_accel < -2::DOUBLE then 'BRAKING'
 when signed_accel > 1.5::DOUBLE then 'ACCELERATING' else 'MOVING' end"""


def _traj(out, pos):
    """CTEs for gap filling and derivatives of ``pos``."""
    return {
        f"{out}_gap": (
            [pos],
            f"""select *, lag(frame_id) over w as pf, lag(x) over w as ox, lag(y) over w as oy
            from {pos} window w as (partition by video_id, track_id order by frame_id)""",
        ),
        f"{out}_fill": (
            [f"{out}_gap"],
            f"""select video_id, track_id, pf + i as frame_id, null::DOUBLE as ts, null::BIGINT as box_ord, false as is_real,
              ox + i::DOUBLE / (frame_id - pf)::DOUBLE * (x - ox) as x, oy + i::DOUBLE / (frame_id - pf)::DOUBLE * (y - oy) as y
            from (select *, unnest(range(1, frame_id - pf)) as i from {out}_gap where frame_id - pf - 1 between 1 and 5)
            union all select video_id, track_id, frame_id, ts, box_ord, true, x, y from {out}_gap""",
        ),
        f"{out}_raw": (
            [f"{out}_fill"],
            f"""select *, lag(frame_id) over w as f1, lag(frame_id, 14) over w as f14,
              lag(x) over w as x1, lag(y) over w as y1,
              {_fir('x', VELOCITY, VELOCITY_DIV, 1)} as svx, {_fir('y', VELOCITY, VELOCITY_DIV, 1)} as svy,
              {_fir('x', ACCEL, ACCEL_DIV, 2)} as sax, {_fir('y', ACCEL, ACCEL_DIV, 2)} as say
            from {out}_fill window w as (partition by video_id, track_id order by frame_id)""",
        ),
        out: (
            [f"{out}_raw"],
            f"""select video_id, track_id, frame_id, ts, box_ord, x, y, warm,
              case when warm then svx when f1 = frame_id - 1 then (x - x1) * 10::DOUBLE else 0 end::DOUBLE as vx,
              case when warm then svy when f1 = frame_id - 1 then (y - y1) * 10::DOUBLE else 0 end::DOUBLE as vy,
              case when warm then sax else 0 end::DOUBLE as ax, case when warm then say else 0 end::DOUBLE as ay
            from (select *, coalesce(f14 = frame_id - 14, false) as warm from {out}_raw) where is_real""",
        ),
        f"{out}_motion": (
            [out],
            f"""select *, {STATE} as state from (select *, sqrt(vx*vx + vy*vy) as speed, sqrt(ax*ax + ay*ay) as accel_mag,
              case when vx*ax + vy*ay < 0 then -sqrt(ax*ax + ay*ay) else sqrt(ax*ax + ay*ay) end as signed_accel from {out})""",
        ),
    }


CTE = {
    "passages": (
        [],
        """select 'cam' || (event_id // 500) as video_id, event_id as track_id, event_type,
        cast(json_extract_string(props, '$.k') as int) as k,
        ((event_id % 500) // 40) * 70 + (event_id % 500) % 40 as start_frame from events""",
    ),
    "boxes": (
        ["passages"],
        """select video_id, start_frame + j as frame_id, (start_frame + j) / 10::DOUBLE as ts, (track_id * 7) % 500 as box_ord,
        track_id, cx - 20 as x1, cy - 24 as y1, cx + 20 as x2, cy as y2,
        ((track_id + 3 * j) % 100) / 100::DOUBLE as conf, 2 + k % 4 as cls
        from (select *, 100::DOUBLE + (k * 13) % 800 + (case when track_id % 2 = 0 then 1 else -1 end)
          * ((k % 37) * j + (((track_id % 17) - 8) * j * (j - 1))::DOUBLE / 16::DOUBLE) + (k * j) % 3 as cx,
          (120 + 30 * (track_id % 25) + j * (k % 5 - 2))::DOUBLE as cy
          from (select *, unnest(range(40)) as j from passages) where (j + k) % 24 >= k % 8)""",
    ),
    "calib": (
        [],
        """select 'cam' || s_suppkey as video_id, 5e-2::DOUBLE as h0, 1e-3::DOUBLE * (s_suppkey % 3) as h1, -5::DOUBLE as h2,
        0::DOUBLE as h3, 5e-2::DOUBLE as h4, -2::DOUBLE as h5, 0::DOUBLE as h6, 1e-5::DOUBLE * (s_suppkey % 4) as h7, 1::DOUBLE as h8
        from supplier""",
    ),
    "ground": (
        ["boxes", "calib"],
        """select *, (h0*px + h1*py + h2) / (h6*px + h7*py + h8) as x, (h3*px + h4*py + h5) / (h6*px + h7*py + h8) as y
        from (select *, (x1 + x2) / 2 as px, y2 as py from boxes join calib using (video_id))""",
    ),
    "pos": (["ground"], "select video_id, track_id, frame_id, ts, box_ord, x, y from ground"),
    "sure_pos": (["ground"], "select video_id, track_id, frame_id, ts, box_ord, x, y from ground where conf >= 0.3::DOUBLE"),
    **_traj("traj", "pos"),
    **_traj("sure", "sure_pos"),
    "vehicle_cand": (
        ["traj_motion"],
        """select video_id, frame_id, ts, track_id, track_id as id_lo, track_id as id_hi, 'SPEEDING' as alert_type, 'critical' as severity, speed as v
          from traj_motion where warm and speed > 13.89::DOUBLE
        union all select video_id, frame_id, ts, track_id, track_id, track_id, 'HARD_BRAKING', 'warning', signed_accel
          from traj_motion where warm and signed_accel < -4::DOUBLE
        union all select video_id, frame_id, ts, track_id, track_id, track_id, 'AGGRESSIVE_ACCEL', 'warning', accel_mag
          from traj_motion where warm and accel_mag > 3.5::DOUBLE""",
    ),
    # Rows meet in cells of 5 m: each in its own on the left, in its own and the eight around it on the right.
    "cells": (
        ["traj"],
        "select *, floor(x / 5::DOUBLE)::bigint as cx, floor(y / 5::DOUBLE)::bigint as cy from traj",
    ),
    "around": (
        ["cells"],
        """select * replace (cx + dx as cx, cy + dy as cy) from cells, (select unnest([-1, 0, 1]) as dx),
          (select unnest([-1, 0, 1]) as dy)""",
    ),
    "pairs": (
        ["around"],
        """select * from (select a.video_id, a.frame_id, a.ts, a.track_id as a_id, b.track_id as b_id,
          sqrt((b.x - a.x)*(b.x - a.x) + (b.y - a.y)*(b.y - a.y)) as d,
          case when a.warm and b.warm then (b.x - a.x)*(b.vx - a.vx) + (b.y - a.y)*(b.vy - a.vy) < 0 else true end as closing
          from cells a join around b on a.video_id = b.video_id and a.frame_id = b.frame_id and a.cx = b.cx and a.cy = b.cy
          where a.box_ord < b.box_ord) where d < 5""",
    ),
    "pair_cand": (
        ["pairs"],
        """select video_id, frame_id, ts, a_id as track_id, least(a_id, b_id) as id_lo, greatest(a_id, b_id) as id_hi,
          case when d < 2 then 'COLLISION_SUSPECTED' else 'PROXIMITY_WARNING' end as alert_type,
          case when d < 2 then 'critical' else 'warning' end as severity, d as v from pairs where d < 2 or closing""",
    ),
    "cand": (["vehicle_cand", "pair_cand"], "select * from vehicle_cand union all select * from pair_cand"),
    "fire_times": (
        ["cand"],
        """select video_id, alert_type, id_lo, id_hi, min(ts) as ts from cand group by all
        union all select c.video_id, c.alert_type, c.id_lo, c.id_hi, min(c.ts) from fire_times f join cand c
          on c.video_id = f.video_id and c.alert_type = f.alert_type and c.id_lo = f.id_lo and c.id_hi = f.id_hi
          and c.ts - f.ts >= 3::DOUBLE group by c.video_id, c.alert_type, c.id_lo, c.id_hi""",
    ),
    "fired": (
        ["cand", "fire_times"],
        "select c.* from cand c join fire_times f using (video_id, alert_type, id_lo, id_hi, ts)",
    ),
    "zone": (
        [],
        """select 'cam' || s_suppkey as video_id, 'junction' || s_suppkey as zone_id, s_suppkey,
        (120 + 10 * (s_suppkey % 5))::DOUBLE as l, (820 + 10 * (s_suppkey % 5))::DOUBLE as r from supplier""",
    ),
    "gate": (
        ["zone"],
        """select video_id, zone_id, 0 as idx, 'North' as name, l as ax, 180::DOUBLE as ay, r as bx, 180::DOUBLE as by_ from zone
        union all select video_id, zone_id, 1, 'South', l, 620, r, 620 from zone
        union all select video_id, zone_id, 2, 'East', r, 180, r, 620 from zone
        union all select video_id, zone_id, 3, 'West', l, 180, l, 620 from zone""",
    ),
    "sight": (
        ["ground", "zone"],
        f"""select *, {_pip('px', 'py')} as inside,
          case when ox is null then false else {_pip('ox', 'oy')} end as was_inside
        from (select video_id, track_id, frame_id, ts, px, py, x, y,
            lag(px) over (partition by video_id, track_id order by frame_id) as ox,
            lag(py) over (partition by video_id, track_id order by frame_id) as oy from ground)
          join zone using (video_id)""",
    ),
    "hit": (
        ["sight", "gate"],
        """select *, (case when (px - ox) * (-gy) + (py - oy) * gx >= 0 then 'enter' else 'exit' end) as direction,
          ox + t * (px - ox) as hx, oy + t * (py - oy) as hy
        from (select *, ((ax - ox) * gy - (ay - oy) * gx) / nullif(c, 0) as t, ((ax - ox) * (py - oy) - (ay - oy) * (px - ox)) / nullif(c, 0) as u
          from (select *, (px - ox) * gy - (py - oy) * gx as c from (
            select s.*, g.idx, g.name, ax, ay, bx - ax as gx, by_ - ay as gy from sight s join gate g using (video_id, zone_id) where ox is not null)))
        where abs(c) >= 1e-10 and t between 0 and 1 and u between 0 and 1""",
    ),
    "near": (
        ["sight", "gate"],
        """select * from (select s.*, idx, name, row_number() over (partition by s.video_id, s.zone_id, s.track_id, s.frame_id
            order by (px - (ax + bx) / 2)*(px - (ax + bx) / 2) + (py - (ay + by_) / 2)*(py - (ay + by_) / 2), idx) as rn
          from sight s join gate g using (video_id, zone_id)
          where (s.inside <> s.was_inside) or (ox is null and s.inside)) where rn = 1""",
    ),
    "guess": (
        ["near", "hit"],
        """select n.*, case when inside then 'enter' else 'exit' end as direction from near n
        where not exists (select 1 from hit h where h.video_id = n.video_id and h.zone_id = n.zone_id
          and h.track_id = n.track_id and h.frame_id = n.frame_id)""",
    ),
    "crossing": (
        ["hit", "guess"],
        """select video_id, ts, frame_id, track_id, zone_id, idx as gate_idx, name as gate_name, direction, 'confirmed' as confidence,
          hx as pixel_x, hy as pixel_y, x as real_x, y as real_y from hit
        union all select video_id, ts, frame_id, track_id, zone_id, idx, name, direction, 'estimated', px, py, x, y from guess g
        where direction = 'exit' or ox is null or (
          not exists (select 1 from hit h where h.direction = 'enter' and h.video_id = g.video_id and h.zone_id = g.zone_id
            and h.track_id = g.track_id and h.frame_id < g.frame_id)
          and not exists (select 1 from guess e where e.direction = 'enter' and e.video_id = g.video_id and e.zone_id = g.zone_id
            and e.track_id = g.track_id and e.frame_id < g.frame_id))""",
    ),
    "journey": (
        ["crossing"],
        """select video_id, zone_id, track_id,
          arg_min(struct_pack(gate := gate_name, ts := ts, conf := confidence), frame_id * 10 + gate_idx) filter (direction = 'enter') as en,
          arg_max(struct_pack(gate := gate_name, ts := ts, conf := confidence), frame_id * 10 + gate_idx) filter (direction = 'exit') as ex
        from crossing group by all""",
    ),
    "od": (
        ["journey"],
        """select video_id, zone_id, track_id, en.gate as origin_gate, ex.gate as dest_gate, en.ts as entry_time, ex.ts as exit_time,
          en.conf as entry_confidence, ex.conf as exit_confidence, round(ex.ts - en.ts, 2) as dwell_s,
          case when en.conf = 'confirmed' and ex.conf = 'confirmed' then 'confirmed' else 'estimated' end as od_confidence
        from journey where en is not null and ex is not null""",
    ),
    "eligible": (["boxes"], "select video_id, frame_id, min(ts) as ts from boxes where frame_id > 0 group by all"),
    "interval_tick": (["eligible"], "select * from eligible where frame_id % 3 = 0"),
    "score": (["boxes", "passages"], "select video_id, frame_id, (sum(k) % 50)::DOUBLE / 10::DOUBLE as score from boxes join passages using (video_id, track_id) group by all"),
    "forced": (
        ["eligible", "fired"],
        """with c as (select distinct video_id, frame_id from fired where alert_type in ('COLLISION_SUSPECTED', 'HARD_BRAKING'))
        select distinct c.video_id, (select min(e.frame_id) from eligible e where e.video_id = c.video_id and e.frame_id >= c.frame_id) as frame_id from c""",
    ),
    "macro": (
        ["eligible", "forced", "score"],
        """select e.video_id, e.frame_id, (f.frame_id is not null)::INT as forced,
          (f.frame_id is not null or s.score >= 2)::INT as runs
        from eligible e left join forced f using (video_id, frame_id) left join score s using (video_id, frame_id)
        where e.frame_id % 3 = 0 or f.frame_id is not null""",
    ),
    "look": (
        ["boxes", "sure_motion"],
        """select b.video_id, b.track_id, b.frame_id as tick, b.ts as tick_ts, m.frame_id, m.ts, m.state, m.speed, m.signed_accel
        from boxes b left join sure_motion m on m.video_id = b.video_id and m.track_id = b.track_id
          and m.ts >= greatest(0::DOUBLE, b.ts - 5::DOUBLE) and m.ts <= b.ts
        where b.frame_id > 0 and b.frame_id % 3 = 0""",
    ),
    "segment": (
        ["look"],
        """select video_id, track_id, tick, state, start_ts, coalesce(lead(start_ts) over w, last_ts) as end_ts,
          count(*) over (partition by video_id, track_id, tick) as n
        from (select video_id, track_id, tick, state, ts as start_ts, last_ts from (
            select *, lag(state) over w as before, max(ts) over (partition by video_id, track_id, tick) as last_ts
            from look where ts is not null window w as (partition by video_id, track_id, tick order by ts))
          where before is null or before <> state)
        window w as (partition by video_id, track_id, tick order by start_ts)""",
    ),
    "kept_segment": (["segment"], "select * from segment where n = 1 or end_ts - start_ts >= 0.5::DOUBLE"),
    "now": (
        ["look"],
        """select video_id, track_id, tick, arg_max(speed, ts) as speed, arg_max(signed_accel, ts) as accel, count(ts) as n,
          min(ts) as first_ts, min(tick_ts) as tick_ts from look group by video_id, track_id, tick""",
    ),
    "story": (
        ["now", "kept_segment"],
        """select video_id, track_id, tick as frame_id, tick_ts as ts, 'Vehicle ' || track_id || ': ' || case when n = 0 then 'no history yet (just appeared)'
          else coalesce(words, '') || ' | now: speed=' || printf('%.1f', round(speed, 1)) || ' m/s, accel='
            || case when round(accel, 1) >= 0 then '+' else '' end || printf('%.1f', round(accel, 1) + 0::DOUBLE) || ' m/s²' end as summary
        from now left join (select video_id, track_id, tick, string_agg(case state when 'STOPPED' then 'stationary' else lower(state) end
            || ' for ' || printf('%.1f', round(end_ts - start_ts, 1)) || 's', ' → ' order by start_ts) as words
          from kept_segment group by all) using (video_id, track_id, tick)""",
    ),
    "run": (
        ["traj_motion"],
        """select video_id, track_id, state, ts as start_ts,
          coalesce(lead(ts) over (partition by video_id, track_id order by ts), last_ts) as end_ts
        from (select *, lag(state) over (partition by video_id, track_id order by ts) as before,
            max(ts) over (partition by video_id, track_id) as last_ts from traj_motion)
        where before is null or before <> state""",
    ),
    "texts": (
        ["passages"],
        """select video_id, frame_id, ts, k, case when k % 11 = 0 then null when k % 11 = 1 then []::BIGINT[] else [track_id, track_id + 1] end as active_ids,
          case k % 8 when 0 then '[' || one || ', ' || two || ']' when 1 then '```json' || chr(10) || '[' || one || ', ' || two || ']' || chr(10) || '```'
           when 2 then 'The scene is busy.' || chr(10) || 'Two users meet.' || chr(10) || '[' || one || ']'
           when 3 then replace('[' || one || ']', '"', chr(39)) when 4 then '[' || one || ', ' || two
           when 5 then '[{"subject": "Vehicle 1", "object": " "}, ' || two || ']' when 6 then '[' || one || ', 5, "x", ' || two || ']'
           else 'Nothing of note.' end as raw_text
        from (select *, start_frame + 20 as frame_id, (start_frame + 20) / 10::DOUBLE as ts,
          '{"subject": "Vehicle ' || track_id || '", "predicate": "' || event_type || '", "object": "' ||
          case k % 4 when 0 then 'Vehicle ' || (track_id + 1) when 1 then 'Pedestrian ' || (k % 9) when 2 then 'traffic_light' else 'Vehicle ' || (track_id + 40) end ||
          '", "motion_state": "' || case k % 3 when 0 then 'parallel' when 1 then 'FLYING' else 'DIVERGING' end ||
          '", "phase": "' || case k % 5 when 0 then 'Conflict' when 1 then 'resolution' else '' end || '"}' as one,
          '{"subject": "Pedestrian ' || (k % 9) || '", "predicate": "crossing", "object": "Vehicle ' || track_id || '"}' as two from passages)""",
    ),
    "answer": (
        ["texts"],
        r"""select *, case when json_valid(body) and body <> '' then cast(json_extract(body, '$[*]') as JSON[]) end as items
        from (select *, regexp_extract(replace(replace(raw_text, '```json', ''), '```', ''), '\[.*\]', 0, 's') as body from texts)""",
    ),
    "item": (["answer"], "select * exclude (items, raw_text, body), unnest(items) as item, generate_subscripts(items, 1) - 1 as ord from answer"),
    "triple": (
        ["item"],
        """select * exclude (item) from (select *, json_extract_string(item, '$.subject') as subject, json_extract_string(item, '$.predicate') as predicate,
          json_extract_string(item, '$.object') as object, json_extract_string(item, '$.motion_state') as ms, json_extract_string(item, '$.phase') as ph
          from item where json_type(item) = 'OBJECT') where trim(subject) <> '' and trim(predicate) <> '' and trim(object) <> ''""",
    ),
    "typed": (
        ["triple"],
        """select *, case when starts_with(subject, 'Vehicle ') then 'Vehicle' when starts_with(subject, 'Pedestrian') then 'Pedestrian' else 'Infrastructure' end as subject_type,
          case when starts_with(object, 'Vehicle ') then 'Vehicle' when starts_with(object, 'Pedestrian') then 'Pedestrian' else 'Infrastructure' end as object_type,
          case when upper(trim(ms)) in ('APPROACHING', 'DIVERGING', 'PARALLEL', 'STATIONARY') then upper(trim(ms)) else 'APPROACHING' end as motion_state,
          case when lower(trim(ph)) in ('approach', 'conflict', 'resolution', 'normal') then lower(trim(ph)) else 'normal' end as phase from triple""",
    ),
    "judged": (
        ["typed"],
        """select *, active_ids is null or (
          (subject_type <> 'Vehicle' or list_contains(active_ids, try_cast(split_part(subject, ' ', 2) as bigint)))
          and (object_type <> 'Vehicle' or list_contains(active_ids, try_cast(split_part(object, ' ', 2) as bigint)))) as valid from typed""",
    ),
    "valid": (["judged"], "select * from judged where valid"),
    "edge": (
        ["valid"],
        """select video_id, frame_id, ts, subject, subject_type, predicate, object, object_type, motion_state, phase,
          round(greatest(0::DOUBLE, ts - 5::DOUBLE), 1) as win_start, round(ts, 1) as win_end from valid""",
    ),
    "ends": (
        ["edge"],
        """select video_id, frame_id, ts, subject as name, subject_type as entity_type, 'subject' as role, predicate, object as partner, object_type as partner_type, phase from edge
        union all select video_id, frame_id, ts, object, object_type, 'object', predicate, subject, subject_type, phase from edge""",
    ),
    "linked": (
        ["valid"],
        """select * from (select *, lag(win_start) over w as from_start, lag(win_end) over w as from_end
          from (select distinct video_id, frame_id, round(greatest(0::DOUBLE, ts - 5::DOUBLE), 1) as win_start, round(ts, 1) as win_end from valid)
          window w as (partition by video_id order by frame_id)) where from_start is not null""",
    ),
    "precede": (
        ["texts", "linked"],
        """select video_id, 'Vehicle ' || track_id as name, from_start, from_end, win_start as to_start, win_end as to_end, round(win_start - from_start, 6) as gap_seconds
        from (select video_id, frame_id, unnest(active_ids) as track_id from texts) join linked using (video_id, frame_id)""",
    ),
    "tick_count": (
        ["answer", "judged"],
        """select video_id, frame_id, a.elements, coalesce(t.triples, 0) as triples, a.elements - coalesce(t.triples, 0) as malformed, coalesce(t.hallucinated, 0) as hallucinated
        from (select video_id, frame_id, sum(coalesce(len(items), 0))::BIGINT as elements from answer group by all) a
        left join (select video_id, frame_id, count(*) as triples, count(*) filter (not valid) as hallucinated from judged group by all) t using (video_id, frame_id)""",
    ),
    "centroid": (
        [],
        """select query_id, list(m order by i) as query_vec from (select label::BIGINT as query_id, i, sum(floor(e::DOUBLE * 1000000))::DOUBLE / count(*)::DOUBLE / 1000000::DOUBLE as m
          from (select label, unnest(embedding) as e, generate_subscripts(embedding, 1) as i from embeddings) group by all) group by query_id""",
    ),
    "snapshot": (
        ["story"],
        """select video_id || '/' || track_id || '/' || frame_id as profile_id, track_id, summary from
        (select *, lag(summary) over (partition by video_id, track_id order by frame_id) as before from story) where before is distinct from summary""",
    ),
    "term": (
        ["snapshot"],
        r"""select profile_id, term, count(*) as tf from (
            select profile_id, unnest(regexp_extract_all(lower(summary), '[\p{L}\p{N}]+(?:\.\p{N}+)?')) as term from snapshot) group by all""",
    ),
    "idf": (
        ["term"],
        "select term, ln(((select count(*) from snapshot) + 1)::DOUBLE / (count(*) + 1)::DOUBLE) as idf from term group by term",
    ),
    "weight": (["idf"], "select profile_id, term, round(tf * idf * 1000)::bigint as w from term join idf using (term) where round(tf * idf * 1000) > 0"),
    "question": (
        ["idf"],
        r"""select query_id, term, round(tf * idf * 1000)::bigint as q from (select query_id, term, count(*) as tf from (
            select query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+(?:\.\p{N}+)?')) as term from (values
              (0::bigint, 'braking, then stationary'), (1, 'accelerating after moving for 1.0'), (2, 'no history yet'),
              (3, 'stationary for 3.0, speed 0.0')) t(query_id, text)) group by all) join idf using (term) where round(tf * idf * 1000) > 0""",
    ),
    "knn": (
        ["centroid"],
        """select query_id, vec_id, d, row_number() over (partition by query_id order by d, vec_id) as rank
        from (select query_id, vec_id, sqrt(list_sum(list_transform(list_zip(embedding, query_vec), lambda p: (p[1]::DOUBLE - p[2]) * (p[1]::DOUBLE - p[2])))) as d
          from embeddings, centroid)""",
    ),
    "cos": (
        ["centroid"],
        """select query_id, vec_id, list_dot_product(embedding::DOUBLE[], query_vec) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(query_vec, query_vec))) as c
        from embeddings, centroid""",
    ),
    "ask": (
        [],
        """select conv_id, list(role order by turn) as tools, arg_max(text, turn) as answer, sum(length(text))::DOUBLE as ms,
          case when bool_or(role = 'system') then 'full_analysis' else 'semantic_lookup' end as route from conversations group by conv_id""",
    ),
}


#: Steps that are read more than once and are worked out once.
MATERIALIZED = ("traj", "cells", "around", "pairs", "snapshot", "term")


def sql(body, *needs):
    done = []

    def add(name):
        if name in done:
            return
        for dep in CTE[name][0]:
            add(dep)
        done.append(name)

    for n in needs:
        add(n)
    ctes = ",\n".join(f"{n} as {'materialized ' * (n in MATERIALIZED)}({CTE[n][1]})" for n in done)
    return (f"with recursive {ctes}\n" if done else "") + body


def _rank(n, p):
    return f"greatest(1, floor({n} * {p} / 100)::BIGINT)"


def _pct(source, keys, value, pcts):
    """Percentile by position: sorted values at the rank the definition names."""
    k = f"{keys}, " if keys else ""
    by = f"partition by {keys} " if keys else ""
    picks = ", ".join(f"round(max(case when rn = {_rank('n', p)} then v end), 2) as p{p}" for p in pcts)
    return f"""select {k}{picks} from (select {k}{value} as v, row_number() over ({by}order by {value}) as rn,
      count(*) over ({by}) as n from {source}) {'group by ' + keys if keys else ''}"""


SQL = {
    "read_boxes_dedup": sql(
        """select video_id, cls, count(*) as n, sum(case when track_id % 3 <> 0 then box_ord + 500 else box_ord end)::BIGINT as sum_ord,
        sum(case when track_id % 3 <> 0 then x1 + cls else x1 end) as sum_x1, sum(case when track_id % 3 <> 0 then y2 - 1 else y2 end) as sum_y2
        from boxes group by all""", "boxes"),
    "filter_detections": sql(
        "select video_id, cls, count(*) as n, min(conf) as min_conf, sum(frame_id)::BIGINT as sum_frame from boxes where conf >= 0.3::DOUBLE and cls in (2, 3, 5) group by all", "boxes"),
    "label_lookup": """with l as (select event_id, trim(lower(['A ', 'the ', ' AN ', '', 'the a '][user_id % 5 + 1] || upper(event_type) || ' ')) as t from events),
        s as (select event_id, case when starts_with(t, 'a ') then substr(t, 3) when starts_with(t, 'an ') then substr(t, 4) when starts_with(t, 'the ') then substr(t, 5) else t end as label from l)
        select label, class_id, count(*) as n, sum(s.event_id)::BIGINT as sum_id from s
        join (select event_type as label, min(event_id) as class_id from events where event_type <> 'error' group by 1) v using (label) group by all""",
    "scene_density": sql(
        """select video_id, density, case when density > 25 then 'minimal' else 'moderate' end as mode, count(*) as n,
        sum(trunc((x1 + x2) / 2))::BIGINT as sum_x, sum(trunc((y1 + y2) / 2))::BIGINT as sum_y, sum(track_id * 37 % 180)::BIGINT as sum_hue
        from (select *, count(*) over (partition by video_id, frame_id) as density from boxes) group by all""", "boxes"),
    "project_to_ground": sql("select video_id, frame_id, track_id, px, py, round(x, 6) as x, round(y, 6) as y from ground", "ground"),
    "frame_times": "select event_id, round((event_id % 500)::DOUBLE / (case when trunc(value) = 0 then 30 else trunc(value) end)::DOUBLE, 6) as ts from events",
    "window_pointers": sql(
        """select video_id, frame_id, printf('%.1f', s) || '-' || printf('%.1f', e) as pointer, s as start_ts
        from (select video_id, frame_id, round(greatest(0::DOUBLE, min(ts) - 5::DOUBLE), 1) as s, round(min(ts), 1) as e from boxes group by all)""", "boxes"),
    "latlon_to_local": """with p as (select 'map' || c_nationkey as file_id, c_custkey as ord, case when c_custkey % 90 = 7 then 'Origin' else c_name end as name,
          12.9::DOUBLE + (c_custkey % 1009) / 100000::DOUBLE as lat, 77.5::DOUBLE + (c_custkey % 997) / 100000::DOUBLE as lon from customer),
        o as (select * from (select *, row_number() over (partition by file_id order by lower(name) <> 'origin', ord) as rn from p) where rn = 1)
        select p.file_id, p.ord, p.name, o.name as origin_name, round((p.lon - o.lon) * 111320::DOUBLE * cos(radians(o.lat)), 4) as world_x,
          round((p.lat - o.lat) * 111320::DOUBLE, 4) as world_y from p join o using (file_id)""",
    "nearest_gates": sql(
        """select video_id, name as gate_name, count(*) as n, round(max(d2), 4) as max_d2 from (
          select video_id, track_id, frame_id, arg_min(name, d2 * 10 + idx * 1e-7::DOUBLE) as name, min(d2) as d2 from (
            select b.video_id, track_id, frame_id, idx, name, (px - (ax+bx)/2)*(px - (ax+bx)/2) + (py - (ay+by_)/2)*(py - (ay+by_)/2) as d2
            from ground b join gate g on b.video_id = g.video_id) group by all) group by all""", "ground", "gate"),
    "validate_zones": """select 'cam' || s_suppkey as video_id, case when s_suppkey % 4 = 3 then '' else 'junction' || s_suppkey end as zone_id,
        case s_suppkey % 4 when 1 then 'polygon needs at least 3 points' when 2 then 'at least one gate is required' when 3 then 'zone_id is blank' else 'ok' end as error from supplier""",
    "track_segments": sql(
        """select video_id, track_id, frame_id, coalesce(frame_id - pf - 1, -1) as gap,
        sum(case when frame_id - pf - 1 <= 5 then 0 else 1 end) over (partition by video_id, track_id order by frame_id)::BIGINT as segment from traj_gap""", "traj_gap"),
    "fill_gaps": sql("select video_id, track_id, frame_id, is_real, round(x, 6) as x, round(y, 6) as y from traj_fill", "traj_fill"),
    "kinematics_cold": sql("select video_id, track_id, frame_id, round(vx, 6) as vx, round(vy, 6) as vy, round(ax, 6) as ax, round(ay, 6) as ay from traj where not warm", "traj"),
    "kinematics_sg": sql("select video_id, track_id, frame_id, round(vx, 6) as vx, round(vy, 6) as vy, round(ax, 6) as ax, round(ay, 6) as ay from traj where warm", "traj"),
    "warm_share": sql("select video_id, count(*) as n, count(*) filter (warm) as warm_rows from traj group by all", "traj"),
    "trajectory_window": sql(
        """select video_id, track_id, frame_id, ts, round(vx, 6) as vx, round(vy, 6) as vy from traj join passages using (video_id, track_id)
        where ts between start_frame / 10::DOUBLE and start_frame / 10::DOUBLE + 2::DOUBLE""", "traj", "passages"),
    "track_lifespan": sql("select video_id, track_id, min(ts) as first_seen, max(ts) as last_seen, count(*) as points from boxes group by all", "boxes"),
    "motion_columns": sql("select video_id, track_id, frame_id, round(speed, 6) as speed, round(accel_mag, 6) as accel_mag, round(signed_accel, 6) as signed_accel from traj_motion", "traj_motion"),
    "behaviour_states": sql("select video_id, track_id, state, count(*) as n from traj_motion group by all", "traj_motion"),
    "rule_speeding": sql(
        """select video_id, track_id, 'violation' as severity, min(ts) filter (speed > 13.89::DOUBLE) as first_occurrence_s, round(max(speed), 2) as max_speed_ms,
        round(max(speed) * 3.6::DOUBLE, 1) as max_speed_kmh, 50::DOUBLE as threshold_kmh,
        round((count(*) filter (speed > 13.89::DOUBLE))::DOUBLE / count(*)::DOUBLE * (max(ts) - min(ts)), 2) as duration_over_limit_s
        from traj_motion group by all having max(speed) > 13.89::DOUBLE""", "traj_motion"),
    "rule_hard_braking": sql(
        """select video_id, track_id, 'warning' as severity, min(ts) filter (signed_accel < -4) as first_occurrence_s, round(abs(min(signed_accel)), 2) as peak_deceleration_ms2,
        4::DOUBLE as threshold_ms2, (count(*) filter (signed_accel < -4))::DOUBLE as frames_in_hard_braking from traj_motion group by all having min(signed_accel) < -4""", "traj_motion"),
    "rule_aggressive_accel": sql(
        """select video_id, track_id, 'warning' as severity, min(ts) filter (accel_mag > 3.5::DOUBLE) as first_occurrence_s, round(max(accel_mag), 2) as peak_accel_ms2,
        3.5::DOUBLE as threshold_ms2, (count(*) filter (accel_mag > 3.5::DOUBLE))::DOUBLE as frames_flagged from traj_motion group by all having max(accel_mag) > 3.5::DOUBLE""", "traj_motion"),
    "rule_violations": sql(
        """select video_id, track_id, 'SPEEDING' as rule_id, 'violation' as severity, min(ts) as first_occurrence_s, count(*) as hits from traj_motion where speed > 13.89::DOUBLE group by all
        union all select video_id, track_id, 'HARD_BRAKING', 'warning', min(ts), count(*) from traj_motion where signed_accel < -4 group by all
        union all select video_id, track_id, 'AGGRESSIVE_ACCELERATION', 'warning', min(ts), count(*) from traj_motion where accel_mag > 3.5::DOUBLE group by all""", "traj_motion"),
    "rule_custom": sql(
        """select video_id, track_id, 'CRAWLING' as rule_id, round(min(speed), 2) as slowest_ms, count(*) filter (warm and speed < 1.5::DOUBLE) as hits
        from traj_motion group by all having count(*) filter (warm and speed < 1.5::DOUBLE) > 0""", "traj_motion"),
    "rule_report": sql(
        """select *, case when violation_count = 0 then 'NO_VIOLATIONS' else 'VIOLATIONS' end as result from (select video_id, track_id,
        (bool_or(speed > 13.89::DOUBLE)::INT + bool_or(signed_accel < -4)::INT + bool_or(accel_mag > 3.5::DOUBLE)::INT) as violation_count from traj_motion group by all)""", "traj_motion"),
    "physics_stats": sql(
        """select video_id, track_id, round(max(speed), 2) as max_speed_ms, round(max(speed) * 3.6::DOUBLE, 1) as max_speed_kmh,
        round(min(signed_accel), 2) as min_signed_accel_ms2, min(signed_accel) < -4 as hard_braking_detected, count(*) as data_points from traj_motion group by all""", "traj_motion"),
    "physics_stats_window": sql(
        """select video_id, track_id, t0, t1, round(max(speed), 2) as max_speed_ms, round(max(speed) * 3.6::DOUBLE, 1) as max_speed_kmh,
        round(min(signed_accel), 2) as min_signed_accel_ms2, min(signed_accel) < -4 as hard_braking_detected, count(*) as data_points
        from traj_motion join (select video_id, track_id, start_frame / 10::DOUBLE + 1::DOUBLE as t0, start_frame / 10::DOUBLE + 3::DOUBLE as t1 from passages) using (video_id, track_id)
        where ts between t0 and t1 group by all""", "traj_motion", "passages"),
    "alert_speeding": sql("select video_id, track_id, frame_id, severity, round(v * 3.6::DOUBLE, 1) as speed_kmh from vehicle_cand where alert_type = 'SPEEDING'", "vehicle_cand"),
    "alert_hard_braking": sql("select video_id, track_id, frame_id, severity, round(v, 2) as signed_accel_ms2 from vehicle_cand where alert_type = 'HARD_BRAKING'", "vehicle_cand"),
    "alert_aggressive": sql("select video_id, track_id, frame_id, severity, round(v, 2) as accel_mag_ms2 from vehicle_cand where alert_type = 'AGGRESSIVE_ACCEL'", "vehicle_cand"),
    "pair_distances": sql("select video_id, frame_id, a_id, b_id, round(d, 6) as distance_m, closing from pairs", "pairs"),
    "alert_collision": sql("select video_id, frame_id, track_id, id_lo, id_hi, severity, round(v, 2) as distance_m from pair_cand where alert_type = 'COLLISION_SUSPECTED'", "pair_cand"),
    "alert_proximity": sql("select video_id, frame_id, track_id, id_lo, id_hi, severity, round(v, 2) as distance_m from pair_cand where alert_type = 'PROXIMITY_WARNING'", "pair_cand"),
    "alert_cooldown": sql("select video_id, alert_type, id_lo, id_hi, frame_id, track_id from fired", "fired"),
    "alert_history": sql(
        """select video_id, alert_type, id_lo, id_hi, frame_id, severity from fired
        order by ts desc, video_id desc, alert_type desc, id_lo desc, id_hi desc limit 500""", "fired"),
    "alert_effectiveness": sql(
        """select alert_type, fired, n - fired as suppressed, round((n - fired)::DOUBLE / n::DOUBLE, 3) as effectiveness
        from (select alert_type, count(*) as n from cand group by 1) join (select alert_type, count(*) as fired from fired group by 1) using (alert_type)""", "cand", "fired"),
    "zone_membership": sql("select video_id, zone_id, track_id, frame_id, inside::INT as inside from sight", "sight"),
    "confirmed_crossings": sql(
        "select video_id, zone_id, track_id, frame_id, gate_idx, gate_name, direction, confidence, round(pixel_x, 4) as pixel_x, round(pixel_y, 4) as pixel_y from crossing where confidence = 'confirmed'", "crossing"),
    "estimated_crossings": sql(
        "select video_id, zone_id, track_id, frame_id, gate_idx, gate_name, direction, confidence from crossing where confidence = 'estimated'", "crossing"),
    "crossings": sql(
        """select video_id, zone_id, track_id, frame_id, gate_idx, gate_name, direction, confidence, ts, round(pixel_x, 4) as pixel_x, round(pixel_y, 4) as pixel_y,
        round(real_x, 6) as real_x, round(real_y, 6) as real_y from crossing""", "crossing"),
    "gate_counts": sql(
        "select video_id, zone_id, gate_name, count(*) filter (direction = 'enter') as enter, count(*) filter (direction = 'exit') as exit from crossing group by all", "crossing"),
    "gate_counts_window": sql(
        """select video_id, zone_id, gate_name, count(*) filter (direction = 'enter') as enter, count(*) filter (direction = 'exit') as exit
        from crossing where ts between 10 and 60 and gate_name = 'North' group by all""", "crossing"),
    "gate_vehicle_counts": sql(
        """select g.video_id, g.zone_id, g.name as gate_name, coalesce(e.n, 0) as entered, coalesce(x.n, 0) as exited from gate g
        left join (select video_id, zone_id, en.gate as name, count(*) as n from journey where en is not null group by all) e using (video_id, zone_id, name)
        left join (select video_id, zone_id, ex.gate as name, count(*) as n from journey where ex is not null group by all) x using (video_id, zone_id, name)""", "gate", "journey"),
    "od_pairs": sql(
        """select video_id, zone_id, track_id, origin_gate, dest_gate, entry_time, exit_time, entry_confidence, exit_confidence, round(exit_time - entry_time, 2) as dwell_s,
        case when entry_confidence = 'confirmed' and exit_confidence = 'confirmed' then 'confirmed' else 'estimated' end as od_confidence from
        (select video_id, zone_id, track_id, gate_name as origin_gate, confidence as entry_confidence, min(ts) as entry_time from crossing where direction = 'enter' group by all)
        join (select video_id, zone_id, track_id, gate_name as dest_gate, confidence as exit_confidence, max(ts) as exit_time from crossing where direction = 'exit' group by all) using (video_id, zone_id, track_id)""", "crossing"),
    "od_summary": sql("select * from od", "od"),
    "od_matrix": sql("select video_id, zone_id, origin_gate, dest_gate, count(*) as vehicles from od group by all", "od"),
    "zone_volume": sql("select video_id, zone_id, count(*) filter (direction = 'enter') as volume from crossing group by all", "crossing"),
    "occupancy": sql(
        "select video_id, zone_id, count(*) filter (inside) as occupancy from (select video_id, zone_id, track_id, arg_max(inside, frame_id) as inside from sight where ts <= 30 group by all) group by all", "sight"),
    "occupancy_series": sql(
        """select video_id, zone_id, frame_id, change, sum(change) over (partition by video_id, zone_id order by frame_id)::BIGINT as occupancy
        from (select video_id, zone_id, frame_id, sum(inside::INT - was_inside::INT)::BIGINT as change from sight where inside <> was_inside group by all)""", "sight"),
    "top_dwell": sql("select video_id, zone_id, track_id, dwell_s from od order by dwell_s desc, video_id, zone_id, track_id limit 20", "od"),
    "behaviour_runs": sql("select * from run", "run"),
    "lookback_rows": sql("select video_id, track_id, tick as frame_id, n, first_ts from now", "now"),
    "lookback_segments": sql("select video_id, track_id, tick as frame_id, state, start_ts, end_ts from kept_segment", "kept_segment"),
    "lookback_summary": sql("select video_id, track_id, tick as frame_id, round(speed, 4) as now_speed, round(accel, 4) as now_accel, (n = 0)::INT as just_appeared from now", "now"),
    "tick_summaries": sql("select video_id, frame_id, ts, string_agg(summary, chr(10) order by track_id) as behaviour from story group by all", "story"),
    "interval_ticks": sql("select * from interval_tick", "interval_tick"),
    "motion_energy": """with f as (select 'cam' || (vec_id // 125) as video_id, vec_id % 125 as frame_id,
          list_transform(embedding, lambda e: trunc(e::DOUBLE * 128)::INT) as p from embeddings),
        g as (select *, lag(p) over (partition by video_id order by frame_id) as q from f)
        select video_id, frame_id, case when q is null then 999::DOUBLE else
          round(list_sum(list_transform(list_zip(p, q), lambda z: abs(z[1] - z[2])))::DOUBLE / len(p)::DOUBLE, 6) end as score from g""",
    "motion_energy_bytes": """with f as (select 'cam' || (vec_id // 125) as video_id, vec_id % 125 as frame_id,
          list_transform(embedding, lambda e: least(127, trunc(e::DOUBLE * 128)::INT)) as p from embeddings),
        g as (select *, lag(p) over (partition by video_id order by frame_id) as q from f)
        select video_id, frame_id, case when q is null then 999::DOUBLE else
          round(list_sum(list_transform(list_zip(p, q), lambda z: abs(z[1] - z[2])))::DOUBLE / len(p)::DOUBLE, 6) end as score from g""",
    "motion_gate": sql("select video_id, frame_id, score from interval_tick join score using (video_id, frame_id) where score >= 2", "interval_tick", "score"),
    "forced_ticks": sql("select * from forced", "forced"),
    "macro_ticks": sql("select * from macro", "macro"),
    "tick_counts": sql("select video_id, sum(runs)::BIGINT as ticks, sum(forced)::BIGINT as forced_ticks, sum(1 - runs)::BIGINT as motion_skips from macro group by all", "macro"),
    "clip_buffer": sql(
        """select video_id, frame_id, row_number() over (partition by video_id order by frame_id) as tick,
        array_to_string(list(frame_id) over (partition by video_id order by frame_id rows between 5 preceding and current row), ',') as clip from interval_tick""", "interval_tick"),
    "stable_start": """with s as (select 'cam' || (event_id // 500) as video_id, event_id % 500 as f,
          case when event_id % 500 < 30 + cast(json_extract_string(props, '$.k') as int) % 10 then 9::DOUBLE else value end < 45 as calm from events),
        w as (select *, count(*) filter (calm) over (partition by video_id order by f rows between current row and 9 following) as c from s)
        select video_id, coalesce(min(f) filter (c = 10), 0) as stable_frame from w group by 1""",
    "profile_snapshots": sql(
        """select video_id, track_id, frame_id, summary, first_seen, ts as last_seen from
        (select *, lag(summary) over (partition by video_id, track_id order by frame_id) as before from story)
        join (select video_id, track_id, min(ts) as first_seen from boxes group by all) using (video_id, track_id) where before is distinct from summary""", "story", "boxes"),
    "extract_triples": sql("select video_id, frame_id, ord, subject, predicate, object from triple", "triple"),
    "normalise_triples": sql("select video_id, frame_id, ord, subject_type, object_type, motion_state, phase, ts from typed", "typed"),
    "drop_hallucinated": sql("select video_id, frame_id, ord, subject, object from valid", "valid"),
    "triple_drop_counts": sql("select * from tick_count", "tick_count"),
    "entity_check": """select event_id, (event_id % 4 = 0 or (user_id % 3 <> 0 and user_id in (event_id % 150, user_id % 40)))::INT as valid from events""",
    "tick_sentences": sql("select video_id, frame_id, string_agg(subject || ' ' || predicate || ' ' || object || '.', ' ' order by ord) as text from valid group by all", "valid"),
    "event_chunks": """select doc_id, printf('%.1f', doc_id / 10::DOUBLE) || '-' || printf('%.1f', doc_id / 10::DOUBLE + 5::DOUBLE) as time_window, length(text) as n_chars
        from documents where doc_id % 9 <> 0 and trim(text) <> ''""",
    "migrate_interactions": sql("select case when motion_state = 'PARALLEL' then 'APPROACHING' else motion_state end as motion_state, 'normal' as phase, count(*) as n from edge group by all", "edge"),
    "merge_entities": sql("select distinct video_id, entity_type, name from ends", "ends"),
    "count_entities": sql("select entity_type, count(*) as entities from (select distinct video_id, entity_type, name from ends) group by all", "ends"),
    "interaction_edges": sql("select * exclude (ts), printf('%.1f', win_start) || '-' || printf('%.1f', win_end) as \"window\" from edge", "edge"),
    "precedes_edges": sql("select * from precede", "precede"),
    "match_edges": sql("select video_id, frame_id, subject, object, phase from edge where subject_type = 'Vehicle' and object_type = 'Infrastructure' and predicate = 'click'", "edge"),
    "window_chain": sql(
        """, path as (select video_id, name, from_start, from_end, to_start, to_end, 1 as hops from precede
          union all select p.video_id, p.name, p.from_start, p.from_end, e.to_start, e.to_end, p.hops + 1 from path p
          join precede e on e.video_id = p.video_id and e.name = p.name and e.from_start = p.to_start and e.from_end = p.to_end where p.hops < 3)
        select * from path""", "precede"),
    "entity_history": sql("select video_id, frame_id, ts, name, entity_type, role, predicate, partner, phase from ends", "ends"),
    "graph_totals": sql(
        """select (select count(*) from (select video_id, name from ends union select video_id, name from precede)) as nodes,
        (select count(*) from edge) as interactions, (select count(*) from precede) as precedes""", "edge", "ends", "precede"),
    "interaction_partners": sql("select video_id, subject, object, predicate, count(*) as times from edge group by all", "edge"),
    "entity_degree": sql("select video_id, name, count(*) as degree, count(distinct partner) as partners from ends group by all", "ends"),
    "search_events": sql("select query_id, vec_id as chunk_id, rank, round(1 / (1 + d), 4) as score from knn where rank <= 3", "knn"),
    "search_profiles": sql(
        r"""select query_id, profile_id, rank, round(c, 4) as score from (
          select *, row_number() over (partition by query_id order by c desc, profile_id) as rank from (
            select query_id, profile_id, dot::DOUBLE / sqrt(nw::DOUBLE * nq::DOUBLE) as c from (
              select query_id, profile_id, sum(w * q)::bigint as dot from weight join question using (term) group by all)
            join (select profile_id, sum(w * w)::bigint as nw from weight group by all) using (profile_id)
            join (select query_id, sum(q * q)::bigint as nq from question group by all) using (query_id))) where rank <= 20""", "weight", "question"),
    "search_profile_vectors": sql("select query_id, vec_id as profile_id, rank, round(1 / (1 + d), 4) as score from knn where rank <= 3", "knn"),
    "search_many": sql(
        """select query_id, chunk_id, rank, round(1 / (1 + d), 4) as score from (
          select q.vec_id as query_id, e.vec_id as chunk_id, d, row_number() over (partition by q.vec_id order by d, e.vec_id) as rank
          from embeddings q, embeddings e, lateral (select sqrt(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: (p[1]::DOUBLE - p[2]) * (p[1]::DOUBLE - p[2])))) as d)
          where q.vec_id % 20 = 0) where rank <= 5"""),
    "approx_search": "select vec_id as query_id, 5::bigint as n, true as recall_ok from embeddings where vec_id % 20 = 0",
    "search_events_window": sql(
        "select query_id, vec_id as chunk_id, rank, printf('%.1f-%.1f', vec_id * 2.5::DOUBLE, vec_id * 2.5::DOUBLE + 5) as time_window from knn where rank <= 4", "knn"),
    "search_cosine": sql(
        "select * from (select query_id, vec_id as chunk_id, row_number() over (partition by query_id order by 1 - c, vec_id) as rank, round(1 - c, 6) as distance from cos) where rank <= 5", "cos"),
    "classify_intent": sql(
        """select vec_id, case when f >= s then 'full_analysis' else 'semantic_lookup' end as intent, round(f, 6) as full_score, round(s, 6) as lookup_score
        from (select vec_id, max(c) filter (query_id < 5) as f, max(c) filter (query_id >= 5) as s from cos group by 1)""", "cos"),
    "percentile_floor": _pct("events", "event_type", "value", (50, 95, 99)).replace("event_type, round", "event_type as op, round"),
    "throughput": sql("select count(*) as frames, 142.3::DOUBLE as elapsed_s, round(count(*)::DOUBLE / 142.3::DOUBLE, 2) as fps from (select distinct video_id, frame_id from boxes)", "boxes"),
    "model_quality": sql(
        """select *, calls - parse_successes as parse_failures, round(parse_successes::DOUBLE / calls, 3) as parse_rate, round(total_triples::DOUBLE / parse_successes, 2) as triples_per_call,
          round(hallucinated::DOUBLE / total_triples, 3) as hallucination_rate, round((total_triples - incomplete)::DOUBLE / total_triples, 3) as completeness_rate
        from (select count(*) as calls, count(*) filter (triples > 0) as parse_successes, sum(triples)::BIGINT as total_triples,
          (sum(hallucinated) filter (triples > 0))::BIGINT as hallucinated, (sum(malformed) filter (triples > 0))::BIGINT as incomplete from tick_count)""", "tick_count"),
    "alert_metrics": sql(
        """select sum(fired)::BIGINT as alerts_total, sum(n - fired)::BIGINT as suppressed, round(sum(n - fired)::DOUBLE / sum(n)::DOUBLE, 3) as effectiveness,
          '{' || string_agg('"' || alert_type || '":' || fired, ',' order by alert_type) || '}' as distribution
        from (select alert_type, count(*) as n from cand group by 1) join (select alert_type, count(*) as fired from fired group by 1) using (alert_type)""", "cand", "fired"),
    "store_metrics": f"""select op, calls, rows_written, avg_similarity, p50, p95 from (select event_type as op, count(*) as calls, sum(user_id % 100)::BIGINT as rows_written,
          coalesce(round(avg(case when event_type = 'view' then floor(value * 100)::DOUBLE / 10000::DOUBLE end), 4), 0::DOUBLE) as avg_similarity from events group by 1)
        join ({_pct('events', 'event_type', 'value', (50, 95)).replace('event_type, round', 'event_type as op, round')}) using (op)""",
    "agent_metrics": sql(
        f"""select a.*, l.p50 as latency_p50, l.p95 as latency_p95, round(tool_calls::DOUBLE / queries, 2) as tools_per_query, round(empty_answers::DOUBLE / queries, 3) as empty_rate
        from (select count(*) as queries, sum(len(tools))::BIGINT as tool_calls, count(*) filter (length(trim(answer)) < 10) as empty_answers from ask) a,
        ({_pct('ask', '', 'ms', (50, 95))}) l""", "ask"),
    "tool_distribution": "select role as tool, count(*) as calls from conversations group by 1",
    "route_distribution": sql("select route, count(*) as queries from ask group by 1", "ask"),
    "brake_before_exit": sql(
        """select zone_id, video_id, track_id, origin_gate, count(*) as braking_frames, round(abs(min(signed_accel)), 2) as peak_deceleration_ms2
        from od join traj_motion m using (video_id, track_id) where m.ts between entry_time and exit_time and signed_accel < -4 group by all""", "od", "traj_motion"),
    "interaction_speed": sql(
        """select v.video_id, v.track_id, v.frame_id, v.predicate, round(m.speed, 6) as speed from
        (select video_id, frame_id, predicate, try_cast(split_part(name, ' ', 2) as bigint) as track_id from ends where entity_type = 'Vehicle' and partner_type = 'Pedestrian') v
        asof left join traj_motion m on v.video_id = m.video_id and v.track_id = m.track_id and v.frame_id >= m.frame_id""", "ends", "traj_motion"),
    "top_acceleration": sql(
        """select video_id, track_id, round(max(signed_accel), 2) as peak_accel_ms2, round(max(speed), 2) as max_speed_ms from traj_motion where warm group by all
        order by peak_accel_ms2 desc, max_speed_ms desc, video_id, track_id limit 20""", "traj_motion"),
    "top_speed": sql(
        "select video_id, track_id, round(max(speed), 2) as max_speed_ms from traj_motion group by all order by max_speed_ms desc, video_id, track_id limit 20", "traj_motion"),
    "incident": sql(
        """, w as (select distinct query_id as incident_id, video_id, win_start, win_end from (select query_id, vec_id from knn where rank <= 2) join edge on subject = 'Vehicle ' || vec_id),
        v as (select distinct incident_id, video_id, win_start, win_end, try_cast(split_part(name, ' ', 2) as bigint) as track_id
          from (select video_id, round(greatest(0::DOUBLE, ts - 5::DOUBLE), 1) as win_start, round(ts, 1) as win_end, name from ends where entity_type = 'Vehicle') join w using (video_id, win_start, win_end)),
        m as (select * from v join traj_motion using (video_id, track_id) where ts between win_start and win_end)
        select incident_id, video_id, track_id, 'SPEEDING' as rule_id, min(ts) as first_occurrence_s, count(*) as hits from m where speed > 13.89::DOUBLE group by all
        union all select incident_id, video_id, track_id, 'HARD_BRAKING', min(ts), count(*) from m where signed_accel < -4 group by all
        union all select incident_id, video_id, track_id, 'AGGRESSIVE_ACCELERATION', min(ts), count(*) from m where accel_mag > 3.5::DOUBLE group by all""", "knn", "edge", "ends", "traj_motion"),
    "interactions_by_predicate": sql("select predicate, subject_type, object_type, count(*) as times, min(ts) as first_ts, max(ts) as last_ts from edge group by all", "edge"),
    "timeline": sql(
        """select video_id, track_id, start_ts as ts, 'state' as kind, state as what from run
        union all select video_id, try_cast(split_part(name, ' ', 2) as bigint), ts, 'interaction', predicate from ends where entity_type = 'Vehicle'
        union all select video_id, unnest(case when id_lo = id_hi then [id_lo] else [id_lo, id_hi] end), ts, 'alert', alert_type from fired
        union all select video_id, track_id, ts, 'crossing', gate_name || ' ' || direction from crossing""", "run", "ends", "fired", "crossing"),
    "early_entries": sql(
        "select video_id, zone_id, gate_name, count(*) as entries, count(distinct track_id) as vehicles from crossing where ts between 0 and 30 and direction = 'enter' group by all", "crossing"),
}

SQL["text_vectors"] = r"""with w as (select doc_id, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+'))::bigint as n_words from documents)
select doc_id, n_words, (n_words > 0)::int::double as norm from w"""
_ERRORS = """with p as (select 'cam' || l_suppkey as video_id, l_orderkey, l_linenumber, l_partkey, l_quantity * 25::DOUBLE as pixel_x, (l_partkey % 720)::DOUBLE as pixel_y,
  l_quantity * 1.25::DOUBLE - 5::DOUBLE + l_tax as world_x, (l_partkey % 720) / 20::DOUBLE - 2::DOUBLE + l_discount as world_y, l_suppkey from lineitem),
q as (select *, 1e-5::DOUBLE * (l_suppkey % 4) as h7, 1e-3::DOUBLE * (l_suppkey % 3) as h1 from p),
r as (select *, (5e-2::DOUBLE * pixel_x + h1 * pixel_y + -5::DOUBLE) / (0::DOUBLE * pixel_x + h7 * pixel_y + 1::DOUBLE) as gx,
  (0::DOUBLE * pixel_x + 5e-2::DOUBLE * pixel_y + -2::DOUBLE) / (0::DOUBLE * pixel_x + h7 * pixel_y + 1::DOUBLE) as gy from q),
err as (select *, round(sqrt((world_x - gx)*(world_x - gx) + (world_y - gy)*(world_y - gy)), 4) as e from r)
"""
SQL["point_errors"] = _ERRORS + "select video_id, l_orderkey, l_linenumber, l_partkey, pixel_x, e as error_m from err"
SQL["reprojection_error"] = _ERRORS + "select video_id, count(*) as points, round(sqrt(avg(e * e)), 4) as rmse_m from err group by 1 having count(*) >= 4"
_CALLS = sql(_pct("(select (frame_id * 3 + elements)::DOUBLE as ms from tick_count)", "", "ms", (50, 95)), "tick_count")


def _json(key, value, source):
    return f"""select '{{' || string_agg('"' || {key} || '":' || {value}, ',' order by {key}) || '}}' from ({source})"""


_STORE = """'{"calls":' || calls || ',"rows_written":' || rows_written || ',"p50":' || p50 || ',"p95":' || p95 || ',"avg_similarity":0.0}'"""
SQL["metrics_report"] = f"""select t.*, m.*, l.p50 as model_p50, l.p95 as model_p95, g.*, a.*, r.*, q.* exclude (queries), q.queries as agent_queries,
  ({_json('op', _STORE, SQL['store_metrics'])}) as stores,
  ({_json('tool', 'calls', SQL['tool_distribution'])}) as tools, ({_json('route', 'queries', SQL['route_distribution'])}) as routes
from ({SQL['throughput']}) t, ({SQL['model_quality']}) m, ({_CALLS}) l,
  (select sum(motion_skips)::BIGINT as motion_skips, sum(forced_ticks)::BIGINT as forced_ticks from ({SQL['tick_counts']})) g,
  ({SQL['alert_metrics']}) a, ({SQL['graph_totals']}) r, ({SQL['agent_metrics']}) q"""
