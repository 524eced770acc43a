"""The registered raster queries as plain SQL, by separable windows, self-joins and recursion."""

from __future__ import annotations

from quadrille.functions.mosaic import _TABLE, GROUPS, PURE
from quadrille.functions.statistics import CHANGE_BINS, FRAGMENTATION_CLASSES, SPA_CODES
from quadrille.operators.change import CLASS_GROUPS, LAND_GROUPS
from quadrille.operators.morphology import disc
from quadrille.operators.patches import SIZE_CODES
from quadrille.operators.window import pair_frames, pairs_possible
from quadrille.sources.virtual import RASTER_SQL

__all__ = ["oracle_sql"]

OFFSET = {"right": (0, 1), "down": (1, 0), "se": (1, 1), "sw": (1, -1)}


def cells(name: str) -> str:
    return RASTER_SQL[name].replace("as row", 'as "row"')


def _over(part: str, order: str, frame: tuple[int, int]) -> str:
    return f'over (partition by "{part}" order by "{order}" range between {-frame[0]} preceding and {frame[1]} following)'


def _windows(src: str, ind: dict, kinds: tuple[str, ...] = ()) -> str:
    """CTEs c, n, h and s, where s has the sums beside row, col and v."""
    near = "".join(f", t_{k}.v as v_{k}" for k in kinds)
    joins = "".join(f' left join c t_{k} on t_{k}."row" = c."row" + {OFFSET[k][0]} and t_{k}.col = c.col + {OFFSET[k][1]}' for k in kinds)
    h = ", ".join(f"sum({e}) {_over('row', 'col', f[0])} as {n}" for n, (e, f) in ind.items())
    s = ", ".join(f"sum({n}) {_over('col', 'row', f[1])}::bigint as {n}" for n, (e, f) in ind.items())
    return f'c as ({src}), n as (select c."row", c.col, c.v{near} from c{joins}), h as (select "row", col, v, {h} from n), s as (select "row", col, v, {s} from h)'


def _percent(n: str, d: str, unit: int) -> str:
    return f"case when ({d}) = 0 then 102 else least((({n}) * {unit} + ({d})) // (2 * ({d})), 100) end"


def frag(method: str, conn: int, window: int, fixed: bool = False, name: str = "fmap") -> str:
    r = window // 2
    if method == "FAD":
        whole = ((-r, r), (-r, r))
        ctes, n, d, unit, most = _windows(cells(name), {"n": ("(v = 2)::int", whole), "d": ("(v not in (0, 4))::int", whole)}), "n", "d", 200, window * window
    else:
        frames = pair_frames(r, conn)
        ok = lambda k: f"v not in (0, 4) and v_{k} not in (0, 4)"
        num = (lambda k: f"case when v = 2 and v_{k} = 2 then 1 else 0 end") if method == "FAC" else (lambda k: f"case when {ok(k)} then (v = 2)::int + (v_{k} = 2)::int else 0 end")
        ind = {f"n_{k}": (num(k), f) for k, f in frames.items()} | {f"d_{k}": (f"case when {ok(k)} then 1 else 0 end", f) for k, f in frames.items()}
        ctes = _windows(cells(name), ind, tuple(frames))
        n, d = " + ".join(f"n_{k}" for k in frames), " + ".join(f"d_{k}" for k in frames)
        unit, most = 200 if method == "FAC" else 100, pairs_possible(window, conn)
    metric = _percent(n, str(most) if fixed else d, unit)
    return f'with {ctes} select "row", col, (case v when 2 then {metric} when 1 then 101 when 3 then 105 when 4 then 106 else 102 end)::smallint as v from s'


def gray(method: str, conn: int, window: int, threshold: int, fixed: bool = False) -> str:
    r = window // 2
    src = f'select "row", col, (case when v between 0 and 100 then v else 101 end)::smallint as v from ({cells("gmap")})'
    if method == "FAD":
        whole = ((-r, r), (-r, r))
        ctes = _windows(src, {"n": ("case when v <= 100 then v else 0 end", whole), "d": ("(v <= 100)::int", whole)})
        n, d, most = "n", "100 * d", 100 * window * window
    else:
        frames = pair_frames(r, conn)
        ok = lambda k: f"v <= 100 and v_{k} <= 100"
        some = lambda k: f" and v > 0 and v_{k} > 0" if method == "FAC" else ""
        ind = {f"n_{k}": (f"case when {ok(k)}{some(k)} then v + v_{k} else 0 end", f) for k, f in frames.items()} | {f"d_{k}": (f"case when {ok(k)} then 1 else 0 end", f) for k, f in frames.items()}
        ctes = _windows(src, ind, tuple(frames))
        n, d = " + ".join(f"n_{k}" for k in frames), "200 * (" + " + ".join(f"d_{k}" for k in frames) + ")"
        most = 200 * pairs_possible(window, conn)
    metric = _percent(n, str(most) if fixed else d, 200)
    return f'with {ctes} select "row", col, (case when v > 100 then 102 when v < {threshold} then 101 else {metric} end)::smallint as v from s'


def mosaic(window: int) -> str:
    r = window // 2
    whole = ((-r, r), (-r, r))
    ctes = _windows(cells("lmap"), {f"n{k}": (f"(v = {k})::int", whole) for k in (1, 2, 3)})
    rows = ", ".join(f"({f}, {a}, {h}, {_TABLE[f, a, h]})" for f in range(10) for a in range(10 - f) for h in (0, 1))
    return f"""with {ctes}, t(f, a, high, code) as (values {rows}),
    p as (select *, n1 + n2 + n3 as n from s),
    q as (select *, least(10 * n2 // greatest(n, 1), 9) as f from p),
    u as (select *, least(10 * n1 // greatest(n, 1), 9 - f) as a from q)
    select u."row", u.col, (case when v = 0 or n = 0 then 0 when n2 = n then {PURE[2]} when n3 = n then {PURE[3]} when n1 = n then {PURE[1]} else code end)::smallint as v
    from u left join t on t.f = u.f and t.a = u.a and t.high = (10 * n3 >= (9 - u.f - u.a) * n)::int"""


def group_case(v: str = "v") -> str:
    return f"case {v} " + " ".join(f"when {k} then {g}" for k, g in GROUPS.items()) + " else 0 end"


def _sum(cond: str, what: str = "1", name: str = "") -> str:
    return f"coalesce(sum(case when {cond} then {what} end), 0)::bigint" + f" as {name}" * bool(name)


def frag_stats(result: str) -> str:
    counts = ", ".join(_sum(f"v between {a} and {b}", name=k) for k, (a, b) in FRAGMENTATION_CLASSES.items())
    pct = ", ".join(f"case when foreground > 0 then round({k} / foreground * 100.0, 6) else 0.0 end as {k}_pct" for k in FRAGMENTATION_CLASSES)
    return f"""with r as ({result}), x as (select {counts}, {_sum('v <= 100', name='foreground')}, {_sum('v = 101', name='background')}, {_sum('v = 102', name='missing')},
        {_sum('v = 105', name='special_3')}, {_sum('v = 106', name='special_4')}, {_sum('v <= 100', 'v', 'total')} from r),
    y as (select *, foreground + background + special_3 + special_4 as reporting_unit from x)
    select *, case when foreground > 0 then round(total / foreground, 6) else 0.0 end as fad_av, case when reporting_unit > 0 then round(total / reporting_unit, 6) else 0.0 end as avcon,
        {pct}, case when reporting_unit > 0 then round(foreground / reporting_unit * 100.0, 6) else 0.0 end as foreground_pct from y"""


def gray_stats(result: str) -> str:
    base = frag_stats(result)
    return f"""with b as ({base}), g as (select {_sum('v between 1 and 100', name='source_foreground')}, {_sum('v = 0', name='source_background')}, {_sum('v not between 0 and 100', name='source_missing')} from ({cells('gmap')}))
    select b.* exclude (special_3, special_4, avcon, foreground_pct, reporting_unit), g.*, foreground + background as reporting_unit,
        case when foreground + background > 0 then round(total / (foreground + background), 6) else 0.0 end as avcon,
        case when foreground + background > 0 then round(foreground / (foreground + background) * 100.0, 6) else 0.0 end as foreground_pct from b, g"""


def histogram(result: str, last: int) -> str:
    return f"with r as ({result}), h as (select v, count(*) as n from r where v between 0 and {last} group by v), e as (select unnest(range({last + 1})) as v) select e.v, coalesce(h.n, 0)::bigint as n, coalesce(h.n, 0) / nullif((select sum(n) from h), 0) as share from e left join h on h.v = e.v"


CHANGE_CASE = "case when a = 101 and b = 101 then 252 when a = 101 and b <= 100 then 250 when a <= 101 and b = 101 then 251 when a <= 100 and b <= 100 then 100 + a - b when a = 102 or b = 102 then 254 when a in (105, 106) or b in (105, 106) then 253 else 102 end"


def change(select: str) -> str:
    return f"""with p as ({frag('FAD', 4, 7)}), q as ({frag('FAD', 4, 7, name='fmap2')}),
    j as (select p."row", p.col, p.v::bigint as a, q.v::bigint as b from p join q on p."row" = q."row" and p.col = q.col),
    t as (select a, b, count(*) as n from j where a <= 106 and b <= 106 group by a, b) {select}"""


def change_stats() -> str:
    both, code = "a <= 100 and b <= 100", "100 + a - b"
    k = lambda c: f"(case when {c} > 100 then 0 when {c} < 10 then 1 when {c} < 40 then 2 when {c} < 60 then 3 when {c} < 90 then 4 else 5 end)"
    s = lambda c, n, w="n": _sum(c, w, n)
    bins = ", ".join(s(f"{both} and {code} between {x} and {y}", n) for n, (x, y) in CHANGE_BINS.items())
    land = "a <= 101 and b <= 101"
    means = ", ".join(f"case when {d}_{w} > 0 then round({d}_total / {d}_{w}, 6) else 0.0 end as {d}_{n}" for d in "ab" for w, n in (("foreground", "fad_av"), ("land", "avcon")))
    return change(f"""select *, {means} from (select {bins}, {s(both, 'common')}, {s('a = 101 and b <= 100', 'gain')}, {s('a <= 100 and b = 101', 'loss')},
        {s(f'{both} and {k("a")} = {k("b")}', 'unchanged')}, {s(f'{land} and {k("b")} > {k("a")}', 'increase')}, {s(f'{land} and {k("b")} < {k("a")}', 'decrease')},
        {s('a <= 100', 'a_foreground')}, {s('b <= 100', 'b_foreground')}, {s('a <= 101 or a in (105, 106)', 'a_land')}, {s('b <= 101 or b in (105, 106)', 'b_land')},
        {s('a <= 100', 'a_total', 'a * n')}, {s('b <= 100', 'b_total', 'b * n')} from t)""")


def change_differences() -> str:
    part = lambda d, w: f"(select sum({d} * n) from t where {d} <= 100) / nullif((select sum(n) from t where {w}), 0)"
    means = ", ".join(f"coalesce({part(d, w.format(d))}, 0.0) as {d}_{n}" for d in "ab" for n, w in (("fad_av", "{0} <= 100"), ("avcon", "{0} <= 101 or {0} in (105, 106)")))
    show = ", ".join(f"round(a_{n}, 6) as a_{n}, round(b_{n}, 6) as b_{n}, round(b_{n} - a_{n}, 6) as {n}_difference, round(case when a_{n} > 0 then (b_{n} - a_{n}) / a_{n} else 0.0 end, 6) as {n}_relative" for n in ("fad_av", "avcon"))
    return change(f"select {show} from (select {means})")


def mosaic_table(lm: str) -> str:
    return f"with r as ({lm}), h as (select v::bigint as pixel_value, count(*) as pixel_count from r where v > 0 group by 1) select *, printf('%.6f', (100 * pixel_count)::double / (select sum(pixel_count) from h)) as foreground_proportion from h"


def change_matrix(groups: dict = CLASS_GROUPS) -> str:
    g = lambda c: "case " + " ".join(f"when {c} in ({', '.join(map(str, v))}) then '{k}'" for k, v in groups.items()) + " end"
    return change(f"select coalesce(ga, 'total') as ga, coalesce(gb, 'total') as gb, sum(n)::bigint as n from (select {g('a')} as ga, {g('b')} as gb, n from t) where ga is not null and gb is not null group by cube (ga, gb)")


def patches() -> str:
    """CTEs f and k, where k has each foreground cell's patch and z the patches' sizes."""
    return f"""with recursive f as (select "row", col, v, "row"::bigint * 1000 + col as id from ({cells('pmap')}) where v = 2),
    e as (select f.id as a, g.id as b from f join f g on g.id in (f.id - 1001, f.id - 1000, f.id - 999, f.id - 1, f.id + 1, f.id + 999, f.id + 1000, f.id + 1001) and abs(g.col - f.col) <= 1),
    k(id, l) using key (id) as (select id, id from f union select e.b, min(x.l) from k x join e on e.a = x.id join recurring.k y on y.id = e.b where x.l < y.l group by e.b),
    z as (select l, count(*) as n from k group by l)"""


SIZE_CASE = "case when n <= 2 then 0 when n <= 10 then 1 when n <= 50 then 2 else 3 end"


def acc_map() -> str:
    code = f"case {SIZE_CASE} " + " ".join(f"when {i} then {c}" for i, c in enumerate(SIZE_CODES)) + " end"
    return f"""{patches()} select m."row", m.col, (case m.v when 2 then {code} when 0 then 129 when 3 then 105 when 4 then 176 else 0 end)::smallint as v
    from ({cells('pmap')}) m left join k on k.id = m."row"::bigint * 1000 + m.col and m.v = 2 left join z on z.l = k.l"""


def acc_stats() -> str:
    return f"""{patches()}, g as (select {SIZE_CASE} as s, count(*) as p, sum(n) as c from z group by 1), t as (select sum(p) as p, sum(c) as c from g),
    sizes(s, code, up_to) as (values (0, 103, 2), (1, 33, 10), (2, 65, 50), (3, 1, null))
    select e.s::bigint as size_class, e.code, e.up_to, coalesce(g.p, 0)::bigint as patches, coalesce(g.c, 0)::bigint as cells,
        case when t.p > 0 then round(coalesce(g.p, 0) / t.p * 100.0, 6) else 0.0 end as patches_pct, case when t.c > 0 then round(coalesce(g.c, 0) / t.c * 100.0, 6) else 0.0 end as cells_pct
    from sizes e left join g on g.s = e.s cross join t"""


def rss() -> str:
    return f"""{patches()}, x as (select count(*) as patches, coalesce(sum(n), 0)::bigint as foreground, avg(n) as mean_size, quantile_cont(n, 0.5)::double as median_size, max(n) as largest, sqrt(sum(n::double * n)) as eca from z),
    b as (select count(*) as background from ({cells('pmap')}) where v = 1)
    select patches, foreground, background, round(mean_size, 6) as mean_size, round(median_size, 6) as median_size, largest,
        round(foreground / (foreground + background) * 100.0, 6) as rac, round_even(eca, 0)::bigint as eca, round(eca / foreground * 100.0, 6) as coh,
        case when abs(foreground::double * foreground - eca * eca) < 1e-9 then -9999 else round_even(1 + 2 * foreground * eca * eca / (foreground::double * foreground - eca * eca), 0) end::bigint as cnoa,
        round(100 - eca / foreground * 100.0, 6) as rpot from x, b"""


def spa(edge: int, classes: int) -> str:
    """On a grid with a frame; distances are joins with the disc's offsets, floods are recursions."""
    pad = 2 * edge + 4
    d = ", ".join(f"({i}, {j})" for i, j in disc(edge))
    n8 = ", ".join(f"({i}, {j})" for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j)
    n4 = "(0, 1), (1, 0), (0, -1), (-1, 0)"
    near = lambda src: f"(select distinct s.r + d.i as r, s.c + d.j as c from {src} s, d)"
    flood = lambda name, within, seeds, nb: f"{name}(r, c) as (select r, c from {within} semi join ({seeds}) using (r, c) union select {within}.r, {within}.c from {name} cross join {nb} n join {within} on {within}.r = {name}.r + n.i and {within}.c = {name}.c + n.j)"
    minus = lambda a, b: f"(select r, c from {a} anti join {b} using (r, c))"
    ring = "select r, c from g, box where r = r0 or r = r1 or c = c0 or c = c1"
    edge5, perf5 = (3, 5) if classes >= 5 else (1, 1)
    islet = 9 if classes == 6 else 1
    if classes == 2:
        case = "case when o.v = 0 then 129 when fg.r is null then 0 when core.r is not null or halo.r is not null then 17 else 1 end"
    else:
        case = f"case when o.v = 0 then 129 when hole.r is not null then 100 when fg.r is null then 0 when core.r is not null then 17 when att.r is null then {islet} when halo.r is not null then case when holed.r is not null and cind.r is null then {perf5} else {edge5} end else 1 end"
    joins = "".join(f" left join {t} {t} on {t}.r = o.r and {t}.c = o.c" for t in ("fg", "core", "hole", "att", "halo", "holed", "cind"))
    return f"""with recursive o as (select "row" as r, col as c, v from ({cells('kmap')})), d(i, j) as (values {d}), n8(i, j) as (values {n8}), n4(i, j) as (values {n4}),
    box as (select min(r) - {pad} as r0, max(r) + {pad} as r1, min(c) - {pad} as c0, max(c) + {pad} as c1 from o),
    g as (select a.r, b.c, coalesce(o.v, 0) as v from (select unnest(range(r0, r1 + 1)) as r from box) a cross join (select unnest(range(c0, c1 + 1)) as c from box) b left join o on o.r = a.r and o.c = b.c),
    two as (select r, c from g where v = 2),
    fg as (select r, c from two union select g.r, g.c from g join {near('two')} x on x.r = g.r and x.c = g.c where g.v = 0),
    bg as {minus('g', 'fg')},
    core as {minus('fg', near('bg'))},
    ncore as {minus('g', 'core')},
    {flood('att', 'fg', 'select r, c from core', 'n8')},
    {flood('ext', 'bg', ring, 'n8')},
    {flood('outc', 'ncore', ring, 'n4')},
    hole as (select r, c from bg anti join ext using (r, c) anti join outc using (r, c)),
    holed as {near('hole')},
    nholed as {minus('g', 'holed')},
    {flood('outh', 'nholed', ring, 'n8')},
    cin as {minus('core', 'outh')},
    cind as {near('cin')},
    halo as {near('core')}
    select o.r as "row", o.c as col, ({case})::smallint as v from o{joins}"""


def spa_stats() -> str:
    counts = ", ".join(_sum(f"v = {c}", name=k) for k, c in SPA_CODES.items())
    pct = ", ".join(f"case when foreground > 0 then round({k} / foreground * 100.0, 6) else 0.0 end as {k}_pct" for k in list(SPA_CODES)[:6])
    return f"with r as ({spa(1, 6)}), x as (select {counts}, count(*) as cells from r), y as (select *, cells - background - missing as foreground from x) select *, {pct} from y"


ZONES = """z as (select r_name as zone, 15.0::double + 17 * r_regionkey as cx, -(20.0::double + 5 * r_regionkey) as cy from region),
    sides as (select zone, cx + s.x1 * m.a as x1, cy + s.y1 * m.b as y1, cx + s.x2 * m.a as x2, cy + s.y2 * m.b as y2
        from z, (values (-1, 0, 0, 1), (0, 1, 1, 0), (1, 0, 0, -1), (0, -1, -1, 0)) s(x1, y1, x2, y2), (values (14, 19), (4, 6)) m(a, b)),
    m as (select c."row", c.col, c.v, c.col + 0.5::double as px, -(c."row" + 0.5::double) as py from (%s) c),
    inside as (select zone, "row", col, v from m, sides where (y1 <= py) <> (y2 <= py) and x1 + (py - y1) * (x2 - x1) / (y2 - y1) <= px
        group by zone, "row", col, v having count(*) %% 2 = 1)"""


def oracle_sql() -> dict[str, str]:
    z = "with " + ZONES % cells("fmap")
    out = {"frag_fad": frag("FAD", 4, 27)}
    out |= {f"frag_{m.lower()}{c}": frag(m, c, 27) for m in ("FAC", "FED") for c in (4, 8)}
    out |= {"frag_fad_fixed": frag("FAD", 4, 7, True), "frag_fac8_fixed": frag("FAC", 8, 7, True), "frag_fed4_fixed": frag("FED", 4, 7, True)}
    out |= {f"{k}_tiles": out[k] for k in ("frag_fad", "frag_fac8", "frag_fed8")}
    out["frag_histogram"] = f"select v, n, round(coalesce(share, 0.0), 6) as share from ({histogram(out['frag_fad'], 100)})"
    out["frag_stats"] = frag_stats(out["frag_fac8"])
    out["gray_fad"] = gray("FAD", 4, 9, 30)
    out |= {f"gray_{m.lower()}{c}": gray(m, c, 9, 30) for m in ("FAC", "FED") for c in (4, 8)}
    out |= {"gray_fad_fixed": gray("FAD", 4, 9, 30, True), "gray_fac8_fixed": gray("FAC", 8, 9, 30, True), "gray_fed8_tiles": gray("FED", 8, 9, 30)}
    out["gray_stats"] = gray_stats(out["gray_fad"])
    lm = mosaic(7)
    out |= {"mosaic_103": lm, "mosaic_103_tiles": lm, "mosaic_19": f'select "row", col, ({group_case()})::smallint as v from ({lm})'}
    groups = f"select ({group_case()})::bigint as grp, count(*) as n from ({lm}) where v > 0 group by 1"
    out["mosaic_groups"] = f"with g as ({groups}) select grp, n, round(n / (select sum(n) from g) * 100.0, 6) as pct from g"
    out["mosaic_stats"] = f"""with r as ({lm}), g as (select ({group_case()})::bigint as grp, count(*) as n from r where v > 0 group by 1), t as (select * from g order by n desc, grp limit 1)
        select (select count(*) from r where v > 0) as data, (select count(*) from r where v = 0) as missing, (select count(distinct v) from r where v > 0) as codes,
            t.grp as top_group, t.n as top_n, round(t.n / (select sum(n) from g) * 100.0, 6) as top_pct from t"""
    out["change_map"] = change(f'select "row", col, ({CHANGE_CASE})::smallint as v from j')
    out["change_crosstab"] = change("select a, b, n from t")
    out["change_matrix"] = change_matrix()
    out["change_land"] = change_matrix(LAND_GROUPS)
    out["change_stats"] = change_stats()
    out["change_differences"] = change_differences()
    out["mosaic_table"] = mosaic_table(lm)
    h = histogram(out["change_map"], 200)
    out["change_histogram"] = f"select v, n, 100 - v as delta, round(coalesce(share, 0.0) * 100.0, 6) as pct from ({h})"
    out |= {"acc_map": acc_map(), "acc_stats": acc_stats(), "rss": rss()}
    out |= {"spa_6": spa(1, 6), "spa_5": spa(2, 5), "spa_3": spa(1, 3), "spa_2": spa(1, 2), "spa_stats": spa_stats()}
    out["zonal_histogram"] = f"{z} select zone, v, count(*) as n from inside group by zone, v"
    out["zonal_extract"] = f"""{z}, b as (select zone, floor(min(-y1)) as r0, ceil(max(-y1)) - 1 as r1, floor(min(x1)) as c0, ceil(max(x1)) - 1 as c1 from sides group by zone)
        select b.zone, m."row", m.col, (case when i.zone is null then 102 else m.v end)::smallint as v from m join b on m."row" between r0 and r1 and m.col between c0 and c1
        left join inside i on i.zone = b.zone and i."row" = m."row" and i.col = m.col"""
    return out
