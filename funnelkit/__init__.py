"""funnelkit: sales-funnel cleaning and analytics as Spark DataFrame functions.

Every public function takes DataFrames (and plain parameters) and returns a
DataFrame. Nothing is collected to the driver; the caller decides when to act.

Sub-packages:

* ``sources``   - schemas, CSV / Parquet readers and writers, test-data views
* ``functions`` - Column-level helpers (stages, money, dates, text, segments)
* ``operators`` - DataFrame -> DataFrame operators (cleaning, quality, metrics,
                  funnel, drop-off, reports, exact quantiles)
* ``plans``     - composed jobs: the cleaning job, the dashboard, insights
* ``streaming`` - micro-batch adapter for the cleaning steps
"""

__version__ = "0.1.0"
