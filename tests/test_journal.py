from factloom.operators import journal


def replay(accesses, capacity):
    """The same cache, told by a list that is searched."""
    held, out = [], []  # (last use, address, size)
    for seq, address, size in sorted(accesses):
        hit = any(h[1] == address for h in held)
        gone = 0
        if hit:
            held = [(seq, a, n) if a == address else (u, a, n) for u, a, n in held]
        elif size <= capacity:
            while sum(n for *_, n in held) + size > capacity:
                held.remove(min(held))
                gone += 1
            held.append((seq, address, size))
        out.append((seq, hit, gone))
    return out


def test_cache_hits_are_those_of_a_replay(spark):
    rows = [(k % 3, k, f"p{k * 7919 % 13}", 5 + k * 31 % 40) for k in range(300)]
    df = spark.createDataFrame(rows, "cache int, seq bigint, address string, size bigint")
    got = sorted((r.cache, r.seq, r.hit, r.evicted) for r in journal.cache_hits(df, 100).collect())
    assert got == sorted((k, *x) for k in range(3) for x in replay([r[1:] for r in rows if r[0] == k], 100))


def test_stream_and_batch_judge_alike(spark, tmp_path):
    from factloom.sources.files import read_journal, stream_journal
    from factloom.streaming.journal import judge

    kinds = ["prepare", "dispatch", "finish", "check_start", "check_end", "note"]
    lines = [f'{{"sequence": {n}, "kind": "{kinds[(n * 7 + n // 3) % 6 if n % 4 else n // 4 % 6]}", "attempt": "a{n % 5}"}}' for n in range(60)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "events.jsonl").write_text("\n".join(lines) + "\n")
    batch = sorted(tuple(r) for r in journal.judged(read_journal(spark, f"{tmp_path}/in")).select("attempt", "sequence", "kind", "accepted").collect())
    q = judge(stream_journal(spark, f"{tmp_path}/in")).writeStream.format("memory").queryName("judged").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("judged").select("attempt", "sequence", "kind", "accepted").collect()) == batch
