import re
from pathlib import Path

from quarry.llm.secrets import scan


def resident_mb(spark) -> float:
    pid = spark._jvm.java.lang.ProcessHandle.current().pid()
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text()))) / 1024


def test_scan_gives_native_memory_back(spark):
    """What the driver's JVM has freed below a block still in use does not stay with its C library."""
    docs = spark.createDataFrame([(1, "password='abcdefgh' x", "s")], "doc_id long, text string, source string")
    scan(docs)  # code is compiled
    native, size = spark._jvm.io.netty.util.internal.PlatformDependent, 100_000
    blocks = [native.allocateMemory(size) for _ in range(3000)]
    for b in blocks[1:]:
        native.copyMemory(blocks[0], b, size)  # so that it is resident
    for b in blocks[:-1]:
        native.freeMemory(b)
    before = resident_mb(spark)
    assert scan(docs).count() == 1
    assert resident_mb(spark) < before - 150
    native.freeMemory(blocks[-1])
