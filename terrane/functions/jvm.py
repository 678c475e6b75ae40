"""Kernels inside Catalyst expressions: the only module that touches Catalyst's internals.

``Kernels.java`` is compiled by the compiler that Spark itself uses for generated code, packed into a jar and added to the
session, so that drivers and executors have it; an executor that joins later fetches it like any other jar.  A call of a kernel is a
``StaticInvoke`` expression: it runs inside whole-stage code generation, and nested calls hand geometry objects on without
turning them into bytes.  Results come out as EWKB, text, numbers or booleans.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, SparkSession

_SOURCES = [Path(__file__).with_name(f"{name}.java") for name in ("Kernels", "Merge", "SpatialJoins", "Build")]
#: Estimated bytes up to which the smaller side of a spatial join or a nearest-neighbour join becomes an index that tasks share;
#: the session's setting terrane.index.bytes comes first.
SMALL = 8 << 20
#: Estimated bytes up to which the side that looks up is first dealt over all cores: such a table may lie in one row group.
DEALT = 64 << 20


class Bridge:
    """What one session needs to build kernel expressions."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark.sparkContext._jvm
        jar = self._jar()
        spark._jsparkSession.sessionState().resourceLoader().addJar(jar)
        self.loader = spark._jsparkSession.sharedState().jarClassLoader()
        self.build = self.loader.loadClass("terrane.Build").getConstructors()[0].newInstance(self._array())
        self.merges: dict[bool, object] = {}
        self.rule = None
        self.exprs = self.jvm.org.apache.spark.sql.catalyst.expressions

    def _jar(self) -> str:
        sources = [p.read_text() for p in _SOURCES]
        mark = hashlib.sha256("".join(sources).encode()).hexdigest()[:16]
        path = os.path.join(tempfile.mkdtemp(prefix="terrane-jar-"), f"terrane-kernels-{mark}.jar")
        parent = self.jvm.java.lang.Thread.currentThread().getContextClassLoader()
        with zipfile.ZipFile(path, "w") as z:
            for source in sources:
                compiler = self.jvm.org.codehaus.janino.SimpleCompiler()
                compiler.setParentClassLoader(parent)
                compiler.setTargetVersion(8)
                compiler.cook(source)
                code = compiler.getBytecodes()
                for name in code.keySet():
                    z.writestr(name.replace(".", "/") + ".class", bytes(code[name]))
                parent = compiler.getClassLoader()  # later sources see earlier ones
        return path

    def install(self, spark: SparkSession) -> None:
        """Give a session the optimizer rule that plans joins on spatial predicates (SQL's as well)."""
        if getattr(spark, "_terrane_rule", False):
            return
        held = spark._jsparkSession.experimental()
        rules = list(self.jvm.scala.jdk.javaapi.CollectionConverters.asJava(held.extraOptimizations()))
        if not any(r.getClass().getName() == "terrane.SpatialJoins" for r in rules):
            if self.rule is None:
                self.rule = self.loader.loadClass("terrane.SpatialJoins").getConstructors()[0].newInstance(self._array(SMALL, DEALT, spark.sparkContext.defaultParallelism))
            getattr(held, "extraOptimizations_$eq")(self.seq([*rules, self.rule]))
        spark._terrane_rule = True

    def estimate(self, df) -> int:
        """The optimizer's estimate of a table's bytes."""
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))

    def small(self, df) -> bool:
        """Whether a table is small enough to be indexed."""
        return self.estimate(df) <= int(df.sparkSession.conf.get("terrane.index.bytes", str(SMALL)))

    def merger(self, hull: bool):
        """Aggregate function: hull or union of a group, merged before and after the shuffle."""
        if hull not in self.merges:
            made = self.loader.loadClass("terrane.Merge").getConstructors()[0].newInstance(self._array(hull))
            self.merges[hull] = self.jvm.org.apache.spark.sql.functions.udaf(made, self.jvm.org.apache.spark.sql.Encoders.BINARY())
        return self.merges[hull]

    def merge(self, hull: bool, column: Column) -> Column:
        columns = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.spark.sql.Column, 1)
        columns[0] = column._jc
        return Column(self.merger(hull).apply(columns))

    def _array(self, *values):
        array = self.spark.sparkContext._gateway.new_array(self.jvm.java.lang.Object, len(values))
        for i, v in enumerate(values):
            array[i] = v
        return array

    def seq(self, items: list):
        held = self.jvm.java.util.ArrayList()
        for x in items:
            held.add(x)
        return self.jvm.scala.jdk.javaapi.CollectionConverters.asScala(held).toSeq()

    def call(self, kernel: str, kinds: str, out: str, args: list):
        """Expression of a kernel over argument expressions."""
        held = self.jvm.java.util.ArrayList()
        for a in args:
            held.add(a)
        return self.build.call(kernel, kinds, out, held)

    def column(self, kernel: str, kinds: str, out: str, args: list[Column], name: str | None = None) -> Column:
        """The call as a column; calls around it take its expression as it is."""
        return Column(self.build.column(kernel, kinds, out, name or "", *(c._jc for c in args)))


def bridge(spark: SparkSession | None = None) -> Bridge:
    """The bridge of a session, made on first use."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("spatial functions need a session")
    held = getattr(spark.sparkContext, "_terrane_bridge", None)
    if held is None or held.spark._jsparkSession is None:
        held = spark.sparkContext._terrane_bridge = Bridge(spark)
    held.install(spark)
    return held
