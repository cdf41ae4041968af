"""billgrid: accounts-payable document analytics as Spark DataFrame jobs.

Everything here is ``DataFrame -> DataFrame`` (or ``Column -> Column``): page words become
invoice fields, fields become normalized invoices, invoices meet their procurement record,
and a fixed cascade of checks turns the pair into a payment decision.
"""

__version__ = "0.1.0"
