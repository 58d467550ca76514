"""Small hand-made tables with the full schema; columns left out are NULL."""

from tallyhouse.schemas import schema_of


def table(spark, name, *rows):
    schema = schema_of(name)
    unknown = {c for row in rows for c in row} - set(schema.names)
    assert not unknown, unknown
    return spark.createDataFrame([tuple(row.get(c) for c in schema.names) for row in rows], schema)


def tables(spark, **rows):
    return {name: table(spark, name, *given) for name, given in rows.items()}


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
