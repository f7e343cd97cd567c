"""A class of the same name and fields as one in ``test_parameters``."""

from tarn.plans import steps


class Clean(steps.Step):
    n: int

    def build(self, spark, inputs):
        return spark.range(self.n + 100)
