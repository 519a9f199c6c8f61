"""Small tables with planted defects, generated from their description."""

import datetime as dt
from decimal import Decimal

SALES = (
    "order_id string, customer_name string, email string, product string, quantity string, "
    "unit_price string, total_price string, order_date string, region string"
)


def sales(spark):
    """50 rows of text: one bad address, one named date, one price outlier, two
    missing addresses, one missing quantity, one row repeated under a new id, an
    empty column."""
    goods = [("Laptop", "1299.99"), ("Chair", "249.99"), ("Mouse", "29.99"), ("Desk", "899.99"), ("Pad", "9.99")]
    rows = []
    for i in range(1, 51):
        product, price = goods[i % 5]
        day = (dt.date(2024, 1, 4) + dt.timedelta(days=i)).isoformat()
        rows.append(
            [f"ORD-{i:03d}", f"Person {i}", f"person{i}@example.com", product, str(i % 7 + 1), price, None, day,
             ["North", "South", "East", "West"][i % 4]]
        )
    rows[5][2] = "person6_at_example.com"
    rows[9][7] = "Jan 20 2024"
    rows[14][5] = "99999.99"
    rows[19][2] = rows[43][2] = None
    rows[29][4] = None
    rows[26][1:] = rows[0][1:]
    return spark.createDataFrame(rows, SALES)


def employees(spark):
    """30 rows: a repeated key with its whole row, a negative salary, a missing
    salary, a missing address, five missing managers, labels in two spellings."""
    rows = []
    for i in range(1, 31):
        rows.append(
            [f"E{i:03d}", f"Name{i}", ["Engineering", "Sales", "Finance"][i % 3], 60000 + 3000 * i,
             f"name{i}@corp.example", None if i in (10, 15, 16, 17, 18) else "E010", i % 9 != 0]
        )
    rows[10] = list(rows[2])
    rows[20][3] = -5000
    rows[28][3] = None
    rows[29][4] = None
    rows[4][2] = " sales "
    return spark.createDataFrame(
        rows,
        "employee_id string, name string, department string, salary int, email string, manager_id string, "
        "is_active boolean",
    )


def clean_orders(spark):
    """60 rows without any quality defect; one large but harmless quantity."""
    rows = []
    for i in range(1, 61):
        customer, product = i * 7 % 10, i * 5 % 12
        quantity = 100 if i == 32 else [1, 2, 3, 4, 5, 8, 10, 12, 20, 30][i % 10]
        price = round(4.99 + 25 * product, 2)
        rows.append(
            (f"ORD-{i:04d}", f"CUST-{customer:02d}", f"Customer {customer}", f"c{customer}@example.com",
             f"SKU-{product:02d}", f"Product {product}", ["Tools", "Paper", "Lamps"][product % 3], quantity, price,
             round(quantity * price, 2), (dt.date(2024, 1, 5) + dt.timedelta(days=i)).isoformat(),
             ["Completed", "Pending", "Returned"][i % 3])
        )
    return spark.createDataFrame(
        rows,
        "order_id string, customer_id string, customer_name string, customer_email string, product_sku string, "
        "product_name string, category string, quantity int, unit_price double, total_price double, "
        "order_date string, status string",
    )


def shop(spark):
    """Four related tables: customers, products, orders, order_items."""
    spend = [Decimal(300 * (i + 1)) for i in range(19)] + [Decimal(99999)]
    customers = [
        (i + 1, None if i in (3, 8, 13) else f"c{i}@email.example", None if i in (2, 5, 8, 11, 18) else f"555-01{i:02d}",
         None if i == 15 else ["Gold", "Silver", "Bronze"][i % 3], spend[i])
        for i in range(20)
    ]
    products = [(i + 1, f"SKU-{i}", None if i == 8 else 5.0 + i, i % 4) for i in range(10)]
    orders = [(i + 1, i % 12 + 1, dt.datetime(2024, 1, 1 + i), ["new", "sent"][i % 2]) for i in range(15)]
    items = [(i + 1, i % 15 + 1, i % 7 + 1, i % 4 + 1) for i in range(25)]
    make = spark.createDataFrame
    return {
        "customers": make(customers, "customer_id int, email string, phone string, tier string, spend decimal(10,2)"),
        "products": make(products, "product_id int, sku string, price double, supplier int"),
        "orders": make(orders, "order_id int, customer_id int, order_date timestamp, status string"),
        "order_items": make(items, "item_id int, order_id int, product_id int, quantity int"),
    }
