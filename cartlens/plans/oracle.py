"""DuckDB SQL for every named query, written the way the reference computes
it (length table, semi join, inner join, per-item loops as joins), so it
checks the Spark plans' rewrites as well as their results."""

from __future__ import annotations

from cartlens.sources.fixtures import EMBEDDING_CATEGORIES, PART_CATEGORIES

EMB = [str(c) for c in EMBEDDING_CATEGORIES]
PART = [str(c) for c in PART_CATEGORIES]

EVENT_SESSIONS = ("select user_id session_id, cast(json_extract_string(props, '$.k') as int) item_id, "
                  "ts date from events where event_type in ('view', 'click')")
EVENT_PURCHASES = ("select user_id session_id, cast(json_extract_string(props, '$.k') as int) item_id, "
                   "ts date, event_id from events where event_type = 'purchase'")
ORDER_SESSIONS = ("select l_orderkey session_id, l_partkey item_id, l_shipdate date, l_linenumber, l_suppkey "
                  "from lineitem")
CUSTOMER_SESSIONS = ("select o_custkey session_id, l_partkey item_id, l_shipdate date, l_orderkey, "
                     "l_linenumber, l_suppkey from orders join lineitem on o_orderkey = l_orderkey")
EMB_E = "select vec_id, unnest(range(1, 65)) c, unnest(embedding) x from embeddings"
EMB_RAW = ("select vec_id item_id, cast(c as int) feature_category_id, 1 feature_value_id from e where x > 0 "
           "union all select vec_id, cast(c as int), 2 from e where x > cast(0.1 as float)")
EMB_CLEAN = ("select item_id, feature_category_id, min(feature_value_id) feature_value_id "
             "from emb_raw group by item_id, feature_category_id")
PART_RAW = ("select p_partkey item_id, cast(substr(p_brand, 7) as int) feature_category_id, 1 feature_value_id from part "
            "union all select p_partkey, case p_type when 'ECONOMY' then 26 when 'LARGE' then 27 when 'MEDIUM' then 28 "
            "when 'PROMO' then 29 when 'SMALL' then 30 else 31 end, 1 from part "
            "union all select p_partkey, 32 + p_size % 42, 1 from part")


def _encode(src: str, cols=EMB) -> str:
    cells = ", ".join(f"count(*) filter (where feature_category_id = {c}) as \"{c}\"" for c in cols)
    return f"select item_id, {cells} from {src} group by item_id"


def _with(**ctes: str) -> str:
    return "with " + ",\n".join(f"{k} as materialized ({v})" for k, v in ctes.items()) + "\n"


EMB_BASE = dict(e=EMB_E, emb_raw=EMB_RAW, emb_clean=EMB_CLEAN, enc=_encode("emb_clean"))
LENS = "select session_id, count(item_id) nb_items from s group by session_id"


def _cols(prefix: str, cols=EMB) -> str:
    return ", ".join(f"{prefix}\"{c}\"" for c in cols)


def session_lengths() -> str:
    return _with(s=ORDER_SESSIONS) + LENS


def session_count() -> str:
    return _with(s=ORDER_SESSIONS, lens=LENS) + "select count(session_id) n_sessions from lens"


def item_views() -> str:
    return _with(s=EVENT_SESSIONS) + "select item_id, count(item_id) count_seen from s group by item_id"


def item_purchases() -> str:
    return _with(p=EVENT_PURCHASES) + "select item_id, count(item_id) count_purchased from p group by item_id"


def views_vs_purchases() -> str:
    return _with(s=EVENT_SESSIONS, p=EVENT_PURCHASES,
                 seen="select item_id, count(item_id) count_seen from s group by item_id",
                 bought="select item_id, count(item_id) count_purchased from p group by item_id") + \
        ("select seen.item_id, count_seen, count_purchased from seen join bought on seen.item_id = bought.item_id "
         "order by count_seen desc, seen.item_id limit 30")


def length_distribution() -> str:
    return _with(s=CUSTOMER_SESSIONS) + \
        "select session_id, count(item_id) n_consumed_items from s group by session_id"


def clean_features() -> str:
    return _with(e=EMB_E, emb_raw=EMB_RAW) + EMB_CLEAN


def encode_features() -> str:
    return _with(part_raw=PART_RAW,
                 part_clean="select distinct item_id, feature_category_id, feature_value_id from part_raw") + \
        _encode("part_clean", PART)


def short_session_rows() -> str:
    return _with(s=EVENT_SESSIONS, lens=LENS) + \
        "select * from s where session_id in (select session_id from lens where nb_items <= 20)"


def session_feature_rows() -> str:
    return _with(s=EVENT_SESSIONS, **EMB_BASE) + \
        f"select s.item_id, s.session_id, s.date, {_cols('enc.')} from s join enc on s.item_id = enc.item_id"


def _short_joined() -> dict:
    return dict(s=EVENT_SESSIONS, **EMB_BASE, lens=LENS,
                short="select * from s where session_id in (select session_id from lens where nb_items <= 20)",
                j="select short.session_id, enc.* exclude (item_id) from short join enc on short.item_id = enc.item_id")


def session_feature_means() -> str:
    cols = ", ".join(f"avg(j.\"{c}\") as \"{c}\"" for c in EMB)
    return _with(**_short_joined()) + f"select session_id, {cols} from j group by session_id"


def session_preferences() -> str:
    cols = ", ".join(f"case when avg(j.\"{c}\") >= 0.4 then 1 else 0 end as \"{c}\"" for c in EMB)
    return _with(**_short_joined()) + f"select session_id, {cols} from j group by session_id"


def stratum_sessions() -> str:
    return _with(s=ORDER_SESSIONS) + \
        ("select count(item_id) n_consumed_items, session_id from s group by session_id "
         "having count(item_id) = 5 order by session_id limit 4")


def stratum_purchases() -> str:
    return _with(s=EVENT_SESSIONS, p=EVENT_PURCHASES,
                 st="select session_id from s group by session_id having count(item_id) = 20") + \
        "select p.session_id, p.item_id from p join st on p.session_id = st.session_id"


def _profile_ctes() -> dict:
    # per-item loop of the notebook as a join: every feature row of every
    # listed item adds 1 to its category; shares divide by the list length.
    return dict(e=EMB_E, emb_raw=EMB_RAW,
                cats="select cast(c as int) category from range(1, 65) t(c)")


def feature_profile() -> str:
    return _with(s=EVENT_SESSIONS, **_profile_ctes(),
                 n="select session_id, count(*) n from s group by session_id",
                 hits=("select s.session_id, f.feature_category_id category, count(*) k from s "
                       "join emb_raw f on s.item_id = f.item_id group by 1, 2")) + \
        ("select n.session_id, cats.category, coalesce(hits.k, 0) / n.n as share from n cross join cats "
         "left join hits on hits.session_id = n.session_id and hits.category = cats.category")


def profile_comparison() -> str:
    return _with(s=EVENT_SESSIONS, p=EVENT_PURCHASES, **_profile_ctes(),
                 st="select session_id, count(*) n from s group by session_id having count(item_id) = 20",
                 hits=("select s.session_id, f.feature_category_id category, count(*) k from s "
                       "join st on s.session_id = st.session_id join emb_raw f on s.item_id = f.item_id group by 1, 2"),
                 consumed=("select st.session_id, cats.category, coalesce(hits.k, 0) / st.n consumed_share "
                           "from st cross join cats left join hits on hits.session_id = st.session_id "
                           "and hits.category = cats.category"),
                 bought="select p.session_id, p.item_id purchased_item from p join st on p.session_id = st.session_id",
                 item_hits="select item_id, feature_category_id category, count(*) k from emb_raw group by 1, 2") + \
        ("select b.session_id, b.purchased_item, c.category, c.consumed_share, "
         "cast(coalesce(ih.k, 0) as double) / 1 purchased_share from bought b "
         "join consumed c on c.session_id = b.session_id "
         "left join item_hits ih on ih.item_id = b.purchased_item and ih.category = c.category")


def profile_comparison_strata() -> str:
    return " union all ".join(
        f"select x.*, {n} as length from ({profile_comparison().replace('count(item_id) = 20', f'count(item_id) = {n}')}) x"
        for n in (100, 20, 5, 1))


def sample_sessions() -> str:
    unit = "cast('0x' || substr(md5(concat('42:', cast(session_id as varchar))), 1, 8) as bigint) / 4294967296.0"
    frac = ("case when nb_items between 20 and 30 then 0.7::double when nb_items between 31 and 50 then 0.8::double "
            "when nb_items between 51 and 100 then 1.0::double end")
    return _with(s=CUSTOMER_SESSIONS, **EMB_BASE, lens=LENS,
                 kept=f"select session_id from lens where {unit} < {frac}") + \
        (f"select s.session_id, s.date, s.item_id, {_cols('enc.')} from s join enc on s.item_id = enc.item_id "
         "where s.session_id in (select session_id from kept)")


def sample_sessions_sized() -> str:
    unit = "cast('0x' || substr(md5(concat('42:', cast(session_id as varchar))), 1, 8) as bigint) / 4294967296.0"
    band = "case when nb_items between 20 and 30 then 0 when nb_items between 31 and 50 then 1 when nb_items between 51 and 100 then 2 end"
    return _with(s=CUSTOMER_SESSIONS, **EMB_BASE, lens=LENS,
                 keyed=f"select session_id, {unit} as u, {band} as band from lens where nb_items between 20 and 100",
                 counts="select band, count(*) * [0.7::double, 0.8::double, 1.0::double][band + 1] as w from keyed group by band",
                 up_to="select band, sum(w) over (order by band) as c, sum(w) over () as t from counts",
                 rounded="select band, floor(least(100.0::double, floor(t)) * c / t) as r from up_to",
                 quota="select band, r - coalesce(lag(r) over (order by band), 0) as q from rounded",
                 ranked="select session_id, band, row_number() over (partition by band order by u, session_id) as n from keyed",
                 kept="select session_id from ranked join quota using (band) where n <= q") + \
        (f"select s.session_id, s.date, s.item_id, {_cols('enc.')} from s join enc on s.item_id = enc.item_id "
         "where s.session_id in (select session_id from kept)")


def group_mode_values() -> str:
    cols = ", ".join(
        f"case when count(*) filter (where r.\"{c}\" = 0) >= greatest(count(*) filter (where r.\"{c}\" = 1), count(*) filter (where r.\"{c}\" = 2)) "
        f"then 0 when count(*) filter (where r.\"{c}\" = 1) >= count(*) filter (where r.\"{c}\" = 2) then 1 else 2 end::bigint as \"{c}\"" for c in EMB)
    return _with(s=EVENT_SESSIONS, **EMB_BASE, raw=_encode("emb_raw"), lens=LENS) + \
        (f"select s.session_id, {cols} from s join lens using (session_id) join raw r on r.item_id = s.item_id "
         "where nb_items >= 11 group by s.session_id")


def csv_inferred() -> str:
    return _with(s=ORDER_SESSIONS) + "select cast(session_id as int) session_id, cast(item_id as int) item_id, cast(l_linenumber as int) line from s"


def time_spent() -> str:
    return _with(s=EVENT_SESSIONS) + \
        ("select session_id, item_id, date, date_diff('microsecond', date, lead(date) over "
         "(partition by session_id order by date, item_id)) / 1e6 as time_spent from s")


def recent_items() -> str:
    return _with(s=EVENT_SESSIONS) + \
        ("select * from (select session_id, item_id, date, cast(row_number() over "
         "(partition by session_id order by date desc, item_id) as int) recency from s) where recency <= 10")


def _dist(a: str, b: str, cols=EMB) -> str:
    return "(" + " + ".join(f"({a}.\"{c}\" <> {b}.\"{c}\")::int" for c in cols) + ")"


def _vote(cols=EMB) -> dict:
    """C4: the mode of the cluster that most of the ten newest rows are nearest to."""
    idx = list(enumerate(cols))
    d0, d1 = (_sum([f"(r.\"{c}\" <> m.{x}{i})::int" for i, c in idx]) for x in "ab")
    bits = ", ".join(f"case when v.chosen = 1 then m.b{i} else m.a{i} end as \"{c}\"" for i, c in idx)
    return dict(rec=("select * from (select kr.*, row_number() over (partition by session_id order by date desc, "
                     "item_id) rr from kr) where rr <= 10"),
                vote=(f"select r.session_id, case when sum(case when {d1} < {d0} then 1 else 0 end) > 0.5 * count(*) "
                      "then 1 else 0 end chosen from rec r join fm m on m.session_id = r.session_id group by 1"),
                clustered=f"select v.session_id, {bits} from vote v join fm m on m.session_id = v.session_id")


def _above(n: int, cols=EMB) -> str:
    """Rows of sessions of more than ``n`` items with their item vectors."""
    return ("select s.session_id, s.item_id, s.date, " + _cols("enc.", cols) + " from s join enc on "
            f"s.item_id = enc.item_id where s.session_id in (select session_id from lens where nb_items > {n})")


def _prefs_ctes(cols=EMB) -> dict:
    """C3 up to 20 items, C4 above, over CTEs s, lens, enc."""
    means = ", ".join(f"case when avg(j.\"{c}\") >= 0.4 then 1 else 0 end as \"{c}\"" for c in cols)
    return dict(short="select * from s where session_id in (select session_id from lens where nb_items <= 20)",
                j="select short.session_id, enc.* exclude (item_id) from short join enc on short.item_id = enc.item_id",
                kr=_above(20, cols), **_kmodes_ctes("kr", cols=cols), **_vote(cols),
                prefs=(f"select session_id, {means} from j group by session_id union all "
                       f"select session_id, {_cols('', cols)} from clustered"))


def _target_ctes() -> dict:
    return dict(p=EVENT_PURCHASES,
                target=("select session_id, item_id from (select session_id, item_id, row_number() over "
                        "(partition by session_id order by date desc, event_id desc) r from p) where r = 1"))


def _event_prefs() -> dict:
    return dict(s=EVENT_SESSIONS, **EMB_BASE, lens=LENS, **_prefs_ctes(), **_target_ctes())


def _wide_base() -> dict:
    """Customer sessions and the 73 part categories."""
    return dict(s=f"select session_id, item_id, date from ({CUSTOMER_SESSIONS})", part_raw=PART_RAW,
                part_clean="select distinct item_id, feature_category_id, feature_value_id from part_raw",
                enc=_encode("part_clean", PART), lens=LENS)


def _knn(cols=EMB) -> dict:
    return dict(d=f"select prefs.session_id, enc.item_id, {_dist('prefs', 'enc', cols)} distance from prefs cross join enc",
                knn=("select * from (select session_id, cast(row_number() over (partition by session_id "
                     "order by distance, item_id) as int) rank, item_id, distance from d) where rank <= 10"))


def _knn_ctes() -> dict:
    return dict(**_event_prefs(), **_knn())


def pairwise_hamming() -> str:
    return _with(**_event_prefs()) + \
        (f"select target.session_id, target.item_id, {_dist('prefs', 'enc')} distance from target "
         "join prefs on prefs.session_id = target.session_id join enc on enc.item_id = target.item_id")


def knn_items() -> str:
    return _with(**_knn_ctes()) + "select session_id, rank, item_id, distance from knn"


def knn_mrr() -> str:
    return _with(**_knn_ctes()) + \
        ("select avg(coalesce(1.0 / knn.rank, 0.0)) mrr, count(*) n_sessions from target "
         "left join knn on knn.session_id = target.session_id and knn.item_id = target.item_id "
         "where target.session_id in (select session_id from knn)")


def list_reciprocal() -> str:
    return _with(**_knn_ctes()) + "select session_id, avg(1.0 / rank) score from knn group by session_id"


def distance_multiplicity() -> str:
    return _with(**_knn_ctes()) + \
        "select session_id, distance, count(*) multiplicity from d group by session_id, distance"


def next_distance() -> str:
    return _with(**_knn_ctes(), m="select session_id, distance from d group by session_id, distance") + \
        ("select session_id, distance, lead(distance) over (partition by session_id order by distance) "
         "next_distance from m")


# ---------------------------------------------------------------- k-modes
KMODES_ROUNDS = 20
_IDX = list(enumerate(EMB))


def _sum(terms) -> str:
    return "(" + " + ".join(terms) + ")"


def _kmodes_ctes(rows: str, limit: str = "n", cols=EMB) -> dict:
    """Seeds and KMODES_ROUNDS unrolled rounds over CTE ``rows``
    (session_id, item_id, date, one column per category); newest row first
    wins ties.  Final round of a session: least(KMODES_ROUNDS, its row count).
    ``settled`` fails the query if a session that may go on still moved a row
    in the last unrolled round."""
    _IDX = list(enumerate(cols))
    o = ", ".join(f"sum(\"{c}\") o{i}" for i, c in _IDX)
    tot = _sum([f"o{i}" for i, _ in _IDX])
    q1 = ", ".join(f"case when nv = 2 then ((case when 2 * o{i} > n then 1 else 0 end) + {i}) % 2 else 0 end q{i}"
                   for i, _ in _IDX)
    d_q1 = _sum([f"(r.\"{c}\" <> q.q{i})::int" for i, c in _IDX])
    d_q2 = _sum([f"(r.\"{c}\" <> 1 - q.q{i})::int" for i, c in _IDX])
    ctes = {
        "gs": f"select session_id, count(*) n, {o} from {rows} group by session_id",
        "gq": f"select session_id, n, case when {tot} = 0 or {tot} = n * {len(cols)} then 1 else 2 end nv, "
              + ", ".join(f"o{i}" for i, _ in _IDX) + " from gs",
        "q": f"select session_id, {q1} from gq",
        "s0": f"select * from (select r.*, row_number() over (partition by r.session_id order by {d_q1}, "
              f"r.date desc, r.item_id) rn from {rows} r join q on q.session_id = r.session_id) where rn = 1",
        "s1": f"select * from (select r.*, row_number() over (partition by r.session_id order by {d_q2}, "
              f"r.date desc, r.item_id) rn from {rows} r join q on q.session_id = r.session_id) where rn = 1",
        "m0": "select s0.session_id, " + ", ".join(f"s0.\"{c}\" a{i}, s1.\"{c}\" b{i}" for i, c in _IDX)
              + " from s0 join s1 on s0.session_id = s1.session_id",
    }
    d0 = _sum([f"(r.\"{c}\" <> m.a{i})::int" for i, c in _IDX])
    d1 = _sum([f"(r.\"{c}\" <> m.b{i})::int" for i, c in _IDX])
    upd = ", ".join(
        f"(2 * sum(case when cl = 0 then \"{c}\" else 0 end) > count(*) filter (where cl = 0))::int a{i}, "
        f"(2 * sum(case when cl = 1 then \"{c}\" else 0 end) > count(*) filter (where cl = 1))::int b{i}"
        for i, c in _IDX)
    for r in range(1, KMODES_ROUNDS + 1):
        ctes[f"a{r}"] = (f"select r.*, case when {d1} < {d0} then 1 else 0 end cl from {rows} r "
                         f"join m{r - 1} m on m.session_id = r.session_id")
        ctes[f"m{r}"] = f"select session_id, {upd} from a{r} group by session_id"
    last, before = f"a{KMODES_ROUNDS}", f"a{KMODES_ROUNDS - 1}"
    counts = "count(*) filter (where cl = 1) ones, sum(cl * (hash(item_id, date) % 1000003)) mark"
    ctes["settled"] = (
        f"select case when count(*) = 0 then 0 else error('k-modes needs more unrolled rounds') end ok from "
        f"(select session_id, {counts} from {last} group by 1) x join (select session_id, {counts} from {before} group by 1) y "
        f"using (session_id) join gs using (session_id) where gs.n > {KMODES_ROUNDS} and (x.ones, x.mark) is distinct from (y.ones, y.mark)")
    ctes["fin"] = f"select session_id, least({KMODES_ROUNDS}, {limit}) + (select ok from settled) f from gs"
    ctes["fa"] = " union all ".join(
        f"select a{r}.* , {r} rnd from a{r} join fin on fin.session_id = a{r}.session_id and fin.f = {r}"
        for r in range(1, KMODES_ROUNDS + 1))
    ctes["fm"] = " union all ".join(
        f"select m{r}.* from m{r} join fin on fin.session_id = m{r}.session_id and fin.f = {r}"
        for r in range(1, KMODES_ROUNDS + 1))
    return ctes


def _long_rows() -> dict:
    return dict(s=EVENT_SESSIONS, **EMB_BASE, lens=LENS, kr=_above(10))


def _enc_raw() -> dict:
    return dict(e=EMB_E, emb_raw=EMB_RAW, encr=_encode("emb_raw"),
                cells="unpivot encr on columns(* exclude (item_id)) into name c value v")


def value_domain() -> str:
    return _with(**_enc_raw()) + "select distinct cast(v as bigint) as value from cells"


def value_frequency() -> str:
    return _with(**_enc_raw()) + \
        "select cast(c as int) category, cast(v as bigint) as value, count(*) n from cells group by 1, 2"


def group_mode() -> str:
    cols = ", ".join(f"(2 * sum(\"{c}\") > count(*))::int as \"{c}\"" for c in EMB)
    return _with(**_long_rows()) + f"select session_id, {cols} from kr group by session_id"


def kmodes_seeds() -> str:
    return _with(**_long_rows(), **_kmodes_ctes("kr")) + \
        "select session_id, 0 seed, item_id, date from s0 union all select session_id, 1, item_id, date from s1"


def kmodes_density_seeds() -> str:
    """Three seeds: the densest row, then twice the greatest product of density
    and distance to the nearest seed so far; the newest row of equal ones."""
    ones = ", ".join(f"sum(\"{c}\") o{i}" for i, c in enumerate(EMB))
    density = _sum([f"case when r.\"{c}\" = 1 then g.o{i} else g.n - g.o{i} end" for i, c in enumerate(EMB)])
    away = lambda s: _sum([f"(r.\"{c}\" <> {s}.\"{c}\")::int" for c in EMB])
    first = lambda score, frm: (f"select * exclude (rn) from (select r.*, row_number() over (partition by r.session_id "  # noqa: E731
                                f"order by {score} desc, r.date desc, r.item_id) rn from {frm}) where rn = 1")
    return _with(**_long_rows(), g=f"select session_id, count(*) n, {ones} from kr group by session_id",
                 d=f"select r.*, {density} as density from kr r join g on g.session_id = r.session_id",
                 s0=first("r.density", "d r"),
                 s1=first(f"r.density * ({away('a')})", "d r join s0 a on a.session_id = r.session_id"),
                 s2=first(f"r.density * least({away('a')}, {away('b')})",
                          "d r join s0 a on a.session_id = r.session_id join s1 b on b.session_id = r.session_id")) + \
        " union all ".join(f"select session_id, {i} seed, item_id, date from s{i}" for i in range(3))


def kmodes_assign() -> str:
    return _with(**_long_rows(), **_kmodes_ctes("kr")) + "select session_id, item_id, date, cl as cluster from a1"


def kmodes_fit() -> str:
    return _with(**_long_rows(), **_kmodes_ctes("kr")) + "select session_id, item_id, date, cl as cluster from fa"


def cluster_sizes() -> str:
    return _with(**_long_rows(), **_kmodes_ctes("kr")) + \
        "select session_id, cl as cluster, count(*) n from fa group by 1, 2"


def clustered_preferences() -> str:
    return _with(**_long_rows(), **_kmodes_ctes("kr"), **_vote()) + "select * from clustered"


def distance_listing() -> str:
    return _with(**_knn_ctes()) + \
        ("select session_id, distance, min(r) first_position, max(r) last_position from (select session_id, distance, "
         "row_number() over (partition by session_id order by distance, item_id) r from d) group by 1, 2")


def kmodes_fit_wide() -> str:
    return _with(**_wide_base(), kr=_above(10, PART), **_kmodes_ctes("kr", cols=PART)) + \
        "select session_id, item_id, date, cl as cluster from fa"


def clustered_preferences_wide() -> str:
    return _with(**_wide_base(), kr=_above(10, PART), **_kmodes_ctes("kr", cols=PART), **_vote(PART)) + "select * from clustered"


def knn_items_wide() -> str:
    return _with(**_wide_base(), **_prefs_ctes(PART), **_knn(PART)) + "select session_id, rank, item_id, distance from knn"


def top_items() -> str:
    return _with(s=EVENT_SESSIONS) + \
        ("select item_id, count(item_id) count_seen, cast(row_number() over (order by count(item_id) desc, item_id) as int) position "
         "from s group by item_id order by position limit 30")


def cluster_statistics() -> str:
    d_own = _sum([f"(f.\"{c}\" <> case when f.cl = 1 then m.b{i} else m.a{i} end)::int" for i, c in _IDX])
    t0 = _sum([f"(t.\"{c}\" <> m.a{i})::int" for i, c in _IDX])
    t1 = _sum([f"(t.\"{c}\" <> m.b{i})::int" for i, c in _IDX])
    return _with(s=EVENT_SESSIONS, **EMB_BASE, lens=LENS, p=EVENT_PURCHASES,
                 kr0=_above(10),
                 kr=("select kr0.*, date_diff('microsecond', date, lead(date) over (partition by session_id "
                     "order by date, item_id)) / 1e6 as time_spent from kr0"),
                 **_kmodes_ctes("kr"),
                 own=f"select f.session_id, f.cl, f.time_spent, {d_own} d from fa f join fm m on m.session_id = f.session_id",
                 st=("select session_id, cast(count(*) as int) session_length, "
                     "cast(coalesce(var_pop(d) filter (where cl = 0), 0) as float) var1_d, "
                     "cast(coalesce(var_pop(d) filter (where cl = 1), 0) as float) var2_d, "
                     "cast(coalesce(var_pop(time_spent) filter (where cl = 0), 0) as float) var1_t, "
                     "cast(coalesce(var_pop(time_spent) filter (where cl = 1), 0) as float) var2_t "
                     "from own group by session_id"),
                 target=("select session_id, item_id from (select session_id, item_id, row_number() over "
                         "(partition by session_id order by date desc, event_id desc) r from p) where r = 1"),
                 tc=(f"select tg.session_id, case when {t1} < {t0} then 1 else 0 end true_cluster from target tg "
                     "join enc t on t.item_id = tg.item_id join fm m on m.session_id = tg.session_id")) + \
        "select st.*, tc.true_cluster from st left join tc on st.session_id = tc.session_id"


def csv_typed() -> str:
    return "select l_orderkey session_id, l_partkey item_id, l_linenumber line from lineitem"


def csv_strings() -> str:
    return _with(part_raw=PART_RAW) + ("select cast(item_id as varchar) item_id, feature_category_id, "
                                       "cast(feature_value_id as varchar) feature_value_id from part_raw")


def csv_no_header() -> str:
    return ("select cast(l_orderkey as varchar) _c0, cast(l_partkey as varchar) _c1, cast(l_linenumber as varchar) _c2 "
            "from lineitem")


ORACLE: dict[str, str] = {
    name: fn() for name, fn in {
        "session_lengths": session_lengths,
        "session_count": session_count,
        "item_views": item_views,
        "item_purchases": item_purchases,
        "views_vs_purchases": views_vs_purchases,
        "length_distribution": length_distribution,
        "clean_features": clean_features,
        "encode_features": encode_features,
        "short_session_rows": short_session_rows,
        "session_feature_rows": session_feature_rows,
        "session_feature_means": session_feature_means,
        "session_preferences": session_preferences,
        "stratum_sessions": stratum_sessions,
        "stratum_purchases": stratum_purchases,
        "feature_profile": feature_profile,
        "profile_comparison": profile_comparison,
        "profile_comparison_strata": profile_comparison_strata,
        "sample_sessions": sample_sessions,
        "time_spent": time_spent,
        "recent_items": recent_items,
        "pairwise_hamming": pairwise_hamming,
        "knn_items": knn_items,
        "knn_mrr": knn_mrr,
        "list_reciprocal": list_reciprocal,
        "distance_multiplicity": distance_multiplicity,
        "next_distance": next_distance,
        "distance_listing": distance_listing,
        "knn_items_wide": knn_items_wide,
        "knn_items_indexed": knn_items,
        "knn_items_wide_indexed": knn_items_wide,
        "kmodes_fit_wide": kmodes_fit_wide,
        "clustered_preferences_wide": clustered_preferences_wide,
        "top_items": top_items,
        "csv_typed": csv_typed,
        "csv_strings": csv_strings,
        "csv_no_header": csv_no_header,
        "csv_header_schema": encode_features,
        "reused_counts": session_lengths,
        "reused_after_growth": session_lengths,
        "csv_inferred": csv_inferred,
        "sample_sessions_sized": sample_sessions_sized,
        "session_preferences_loaded": session_preferences,
        "time_spent_stored": time_spent,
        "recent_items_stored": recent_items,
        "short_session_rows_stored": short_session_rows,
        "group_mode_values": group_mode_values,
        "value_domain": value_domain,
        "value_frequency": value_frequency,
        "group_mode": group_mode,
        "kmodes_seeds": kmodes_seeds,
        "kmodes_density_seeds": kmodes_density_seeds,
        "kmodes_assign": kmodes_assign,
        "kmodes_fit": kmodes_fit,
        "cluster_sizes": cluster_sizes,
        "clustered_preferences": clustered_preferences,
        "cluster_statistics": cluster_statistics,
    }.items()
}
