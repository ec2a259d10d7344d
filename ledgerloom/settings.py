"""Session settings this package is measured with. All are public Spark settings."""

# Joins copy a side to every task, and build it on the driver first, by its size. Before a
# stage has run that is the size of compressed files, of which tables of a close take a
# fiftieth of what they take in memory; after it, the bytes of its rows.
COPIED = {"spark.sql.autoBroadcastJoinThreshold": 256 << 10,
          "spark.sql.adaptive.autoBroadcastJoinThreshold": 4 << 20}

# A join of a large table with the few keys it is asked for shuffles only rows that may have
# such a key: they pass a Bloom filter of the keys first, 4 MB whatever the number of keys.
# Too many keys make it coarse, not wrong, as the join itself still decides.
FILTERED = {"spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": 64 << 20,
            "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": 2 << 30,
            "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": 4_000_000,
            "spark.sql.optimizer.runtime.bloomFilter.numBits": 32 << 20}

SETTINGS = {
    # Dates are read and compared in UTC.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A close is a few hundred generated classes; the default of 100 compiles them anew
    # for every close.
    "spark.sql.codegen.cache.maxEntries": "5000",
    **{name: str(size) for name, size in (COPIED | FILTERED).items()},
}


def configure(builder):
    """Apply the settings to a session builder."""
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    return builder


def bound_copies(spark):
    """Give a session the limits of ``COPIED`` and ``FILTERED``, unless it has its own."""
    if all(spark.conf.get(name, None) is None for name in COPIED):
        for name, size in COPIED.items():
            spark.conf.set(name, str(size))
    for name, size in FILTERED.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, str(size))
