"""Back-office analytics on Spark DataFrames: tax annexes, commissions, cash
reports, withholding, fiscal documents, partner quality and stock."""
