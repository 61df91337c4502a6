"""keelson: budgeted set selection and paired evaluation as Spark DataFrame operators."""
