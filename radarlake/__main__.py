"""python -m radarlake inspect FILE [--json] | chunks PATH LAYER [--repeat N] [--csv]"""

from __future__ import annotations

import argparse
import json
import math
import time


def nearest_rank(times: list[float], share: float) -> float:
    """The timing at rank ceil(share n)."""
    return sorted(times)[max(0, math.ceil(share * len(times)) - 1)]


def plain(x):
    """JSON has no NaN or infinities: they are strings."""
    if isinstance(x, float) and not math.isfinite(x):
        return "NaN" if math.isnan(x) else "Infinity" if x > 0 else "-Infinity"
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()} | ({"fill_value": plain(x["fill_attr"])} if x.get("fill_attr") is not None else {})
    return [plain(v) for v in x] if isinstance(x, list) else x


def inspect(path: str, as_json: bool) -> str:
    import h5py

    from radarlake.sources.hdf5 import inspect as look

    with h5py.File(path, "r") as f:
        return report(path, look(f), as_json)


def report(path: str, found: dict, as_json: bool) -> str:
    if as_json:
        return json.dumps({"file": path, **plain(found)}, indent=2)
    out = [f"{path}: {found['identification']['product_type']} {found['identification']['granule_id']}"]
    for f in found["frequencies"]:
        out.append(f"  frequency {f['name']}: {f['y']['count']} x {f['x']['count']}, EPSG {f['epsg']}")
    out += [f"  {d['path']}  {d['rows']} x {d['cols']}  {d['dtype']['description']}  {'+'.join(d['filters']) or d['layout']}" for d in found["datasets"]]
    return "\n".join(out)


def chunk_times(path: str, layer: str, repeat: int, csv: bool) -> str:
    """Warm timings of reading a layer's chunks and of their distribution."""
    from radarlake.operators import chunked
    from radarlake.session import session
    from radarlake.sources import chunks

    spark = session()
    stored = chunks.read(spark, path, layer)
    n = stored.count()
    jobs = {"read": lambda: stored.write.format("noop").mode("overwrite").save(), "distribution": lambda: chunked.summary(stored).collect()}
    rows = []
    for name, job in jobs.items():
        times = []
        for _ in range(repeat + 1):
            began = time.perf_counter()
            job()
            times.append(time.perf_counter() - began)
        rows.append((name, n, *(round(1000 * nearest_rank(times[1:], q), 3) for q in (0.5, 0.95))))
    head = ("step", "chunks", "p50_ms", "p95_ms")
    return "\n".join((",".join if csv else "  ".join)(map(str, r)) for r in (head, *rows))


def main(argv: list[str] | None = None) -> str:
    p = argparse.ArgumentParser(prog="radarlake", description=__doc__)
    sub = p.add_subparsers(dest="what", required=True)
    one = sub.add_parser("inspect")
    one.add_argument("file")
    one.add_argument("--json", action="store_true")
    two = sub.add_parser("chunks")
    two.add_argument("path")
    two.add_argument("layer")
    two.add_argument("--repeat", type=int, default=5)
    two.add_argument("--csv", action="store_true")
    a = p.parse_args(argv)
    return inspect(a.file, a.json) if a.what == "inspect" else chunk_times(a.path, a.layer, a.repeat, a.csv)


if __name__ == "__main__":
    print(main())
