"""The queries that SQL can express, for an independent engine."""

from __future__ import annotations

def _merkle() -> str:
    """Trees of up to ``8 ** 7`` rows a language and ``8 ** 3`` languages, level by level."""
    field = "coalesce(octet_length(encode({0}::varchar))::varchar || ':' || {0}::varchar, '-')"
    leaf = lambda text: "sha256(" + " || ".join(
        field.format(text if c == "text" else c) for c in ("doc_id", "source", "lang", "n_chars", "text")
    ) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = """xor(list_reduce([4294967295::bigint] || list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint),
        lambda a, c: list_reduce([xor(a, c)] || range(8), lambda x, _: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""
    ctes = [
        f"""docs as (
            select doc_id, coalesce('=' || lang, '') as tree, {leaf("text")} as leaf,
                   case when {crc} % 3 = 0 then {leaf(lower)} end as changed
            from documents
        )""",
        """a0 as (
            select doc_id, tree, leaf as h, leaf, coalesce(changed, leaf) as f,
                   row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as idx,
                   count(*) over (partition by tree) as n
            from docs
        )""",
    ]

    def levels(name: str, count: int) -> None:
        for k in range(count):
            nodes, up = f"{name}{k}", f"{name}{k + 1}"
            ctes.append(f"""{name}s{k} as (
            select a.tree, a.idx, coalesce(string_agg(b.h, '' order by b.idx) filter (where b.idx <> a.idx), '') as others,
                   count(*) filter (where b.idx < a.idx) as place
            from {nodes} a join {nodes} b on a.tree = b.tree and a.idx // 8 = b.idx // 8 where a.n > 1 group by a.tree, a.idx
        )""")
            ctes.append(f"""{up} as (
            select *, count(*) over (partition by tree) as n from (
                select tree, idx // 8 as idx, sha256(string_agg(h, '' order by idx)) as h from {nodes} where n > 1
                group by tree, idx // 8)
        )""")

    levels("a", 7)
    tops = " union all ".join(f"select tree, h from a{k} where n = 1" for k in range(8))
    ctes.append(f"subroots as ({tops})")
    ctes.append("""b0 as (
            select '' as tree, tree as lang, h, row_number() over (order by tree) - 1 as idx, count(*) over () as n from subroots
        )""")
    levels("b", 3)
    ctes.append("root as (" + " union all ".join(f"select h from b{k} where n = 1" for k in range(4)) + ")")
    steps = [("a", k, "idx") for k in range(7)] + [("b", k, "at") for k in range(3)]
    ctes.append("""p0 as (
            select doc_id, a0.tree, leaf, a0.idx, b0.idx as at, subroots.h as subroot, f, '' as proof
            from a0 join subroots on a0.tree = subroots.tree join b0 on b0.lang = a0.tree
        )""")
    for step, (name, k, index) in enumerate(steps):
        tree = "p.tree" if name == "a" else "''"
        ctes.append(f"""p{step + 1} as (
            select p.* replace (
                case when s.others is null then f
                     else sha256(left(others, (64 * place)::bigint) || f || substr(others, (64 * place + 1)::bigint)) end as f,
                proof || coalesce(others, '') as proof)
            from p{step} p left join {name}s{k} s on s.tree = {tree} and s.idx = p.{index} // {8**k}
        )""")
    return "with " + ",\n        ".join(ctes) + f"""
        select doc_id, leaf, subroot, root.h as root, sha256(proof) as proof_sha256, f as folded_root, f = root.h as verified
        from p{len(steps)} cross join root
    """


SQL = {
    "op12_merkle": _merkle(),
    "op3_mixing": r"""
        with recursive docs as (
            select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size
            from documents
        ),
        weighed as (
            select source, s, ((row_number() over (order by source nulls last) - 1) % 3) + 1.0::double as w,
                   sum(s) over () as total
            from (select source, sum(size)::double as s from docs group by source)
        ),
        judged as (
            select *, 3 * s * rest <= w * (total - cut_before) as is_cut
            from (
                select *, sum(w) over (order by s / w, source nulls last rows between current row and unbounded following) as rest,
                       coalesce(sum(3 * s) over (order by s / w, source nulls last
                                rows between unbounded preceding and 1 preceding), 0) as cut_before
                from weighed
            )
        ),
        targets as (
            select source, s, case when is_cut then 3 * s else
                       (total - sum(case when is_cut then 3 * s else 0 end) over ()) * w
                       / sum(case when is_cut then 0 else w end) over () end as target
            from judged
        ),
        sizes as (
            select targets.source, s, target, size, count(*)::double as n
            from docs join targets on docs.source is not distinct from targets.source group by all
        ),
        -- The multiplier of each source by halving the bracket of its slope.
        halved(source, low, high, step) as (
            select source, -50.0::double, ln(3)::double, 0 from targets
            union all
            select source, case when slope < 0 then middle else low end, case when slope < 0 then high else middle end, step + 1
            from (
                select halved.source, any_value(low) as low, any_value(high) as high, any_value(step) as step,
                       any_value((low + high) / 2) as middle,
                       sum(n * size * least(exp((low + high) / 2 * size), 3)) - any_value(target) as slope
                from halved join sizes on halved.source is not distinct from sizes.source
                where step < 100 group by halved.source
            )
        ),
        rates as (
            select sizes.*, n * least(exp(case when target >= 3 * s then ln(3) else round(high, 13) end * size), 3) as rate
            from sizes join halved on sizes.source is not distinct from halved.source and step = 100
        ),
        rounded as (
            select *, least(floor(sum(rate) over up + 0.381966011250105)
                            - floor(coalesce(sum(rate) over lower, 0) + 0.381966011250105), 3 * n)::bigint as copies
            from rates
            window up as (partition by source order by size rows between unbounded preceding and current row),
                   lower as (partition by source order by size rows between unbounded preceding and 1 preceding)
        ),
        gaps as (select *, round(target)::bigint - sum(copies * size) over (partition by source) as gap from rounded),
        rooms as (
            select *, case when gap > 0 then 3 * n - copies else copies end as room,
                   abs(gap) - coalesce(sum(case when gap > 0 then 3 * n - copies else copies end * size) over (
                       partition by source order by size rows between unbounded preceding and 1 preceding), 0) as missing
            from gaps
        ),
        mended as (
            select source, size, s, target, n::bigint as n,
                   (copies + sign(gap) * case when size > 0 and missing > 0 then least(floor(missing / size), room) else 0 end)::bigint
                       as copies
            from rooms
        ),
        placed as (
            select docs.*, mended.s, mended.target, mended.n, mended.copies,
                   row_number() over (partition by docs.source, docs.size order by doc_id) as place
            from docs join mended on docs.source is not distinct from mended.source and docs.size = mended.size
        )
        select doc_id, size::bigint as size, s::bigint as source_size, target,
               ((place * copies // n - (place - 1) * copies // n) * size)::bigint as taken
        from placed
    """,
    "op6_exact_dedup": """
        select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
               doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
        from documents
        window same as (partition by coalesce(text, ''))
    """,
    "op5_warc": """
        with payloads as (
            select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as hex,
                   max(page_id) over (partition by coalesce(html, '')) as first
            from pages
        ),
        digits as (
            select page_id, string_agg(
                       substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                              ((('0x' || substr(hex, 5 * (d // 4) + 1, 5))::bigint >> (15 - 5 * (d % 4))) & 31)::int + 1, 1),
                       '' order by d) as payload_digest
            from payloads, range(32) as digit(d)
            group by page_id
        )
        select page_id, payload_bytes, payload_digest,
               case when page_id = first then 'response' else 'revisit' end as record_type,
               case when page_id <> first then first end as refers_to
        from payloads join digits using (page_id)
    """,
    "op7_embeddings": """
        with recursive vectors as (
            select vec_id, label, embedding::double[] as v, sqrt(list_inner_product(embedding::double[], embedding::double[])) as n
            from embeddings
            where label is not null and embedding is not null and list_count(embedding) = len(embedding)
                  and len(list_filter(embedding, lambda x: not isfinite(x))) = 0
                  and len(list_filter(embedding, lambda x: x <> 0)) > 0
        ),
        links as (
            select a.vec_id as a, b.vec_id as b
            from vectors a join vectors b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
            where list_inner_product(a.v, b.v) / (a.n * b.n) >= 0.98
        ),
        reach(a, b) as (select vec_id, vec_id from embeddings union select reach.a, links.b from reach join links on reach.b = links.a)
        select vec_id, (select count(*) from links where a = vec_id) as n_links, min(b) as component_id, min(b) = vec_id as kept
        from embeddings join reach on vec_id = reach.a
        group by vec_id
    """,
    "op4_minhash": r"""
        with recursive words as (
            select doc_id, regexp_extract_all(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x20\x09-\x0D]+') as w
            from documents
        ),
        shingles as (
            select distinct doc_id, array_to_string(w[k:k + 3], ' ') as s
            from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) as k from words where len(w) > 0)
        ),
        sizes as (select doc_id, count(*) as n from shingles group by doc_id),
        links as (
            select a.doc_id as a, b.doc_id as b
            from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id
            join sizes m on a.doc_id = m.doc_id join sizes n on b.doc_id = n.doc_id
            group by a.doc_id, b.doc_id, m.n, n.n
            having 100 * count(*) >= 80 * (m.n + n.n - count(*))
        ),
        reach(a, b) as (select doc_id, doc_id from documents union select reach.a, links.b from reach join links on reach.b = links.a)
        select doc_id, coalesce(any_value(sizes.n), 0) as n_shingles, min(b) as component_id, min(b) = doc_id as kept
        from documents join reach on doc_id = reach.a left join sizes using (doc_id)
        group by doc_id
    """,
    "op8_chat": r"""
        with turns as (
            select conv_id, turn, role, coalesce(text, '') as text from conversations
            union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
            union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        ),
        joined as (
            select conv_id, count(*) as n_turns,
                   string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns_text,
                   coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '') as loss,
                   sum(len(role) + len(text) + 9
                       + len(regexp_extract_all(role, '[\\<\[\n]')) + len(regexp_extract_all(text, '[\\<\[]'))) as chars
            from turns group by conv_id
        )
        select conv_id, n_turns, sha256(turns_text) as turns_sha256, len(loss) as loss_chars, sha256(loss) as loss_sha256,
               chars::bigint as formatted_chars
        from joined
    """,
}
