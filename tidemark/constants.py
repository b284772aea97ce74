"""Codes stored in the tables and labels printed by the reports."""

# Fixed values. They must equal the ones the source systems and report readers use.
BUSINESS_ZONE = "Asia/Ho_Chi_Minh"
PAID_STATUSES = (2, 3)
FIRST_PAYMENT = 1
RENEWABLE_PACKAGE_TYPE = 1
UPGRADE_PACKAGE_TYPE = 4
ACTIVE_INVENTORY = 1
ORDER_TYPE = "order"
INCOME_TYPE = "income"
TOTAL_ORDER_WEEK = "total_order"
TOTAL_AMOUNT_WEEK = "total_amount"
