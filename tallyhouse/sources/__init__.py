"""Reading the business tables and writing reports."""
