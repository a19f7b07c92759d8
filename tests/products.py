"""Fourteen heterogeneous product documents: the same names and values of the fields
that queries use, other fields of varying type."""

PRODUCTS = {
    "prod001": {"name": "Laptop", "price": 1299.99, "stock": 45, "category": "Electronics", "rating": 4.7, "available": True, "brand": "Umbra", "specs": {"processor": "i7", "ram": "16GB", "storage": "512GB"}, "tags": ["thin", "office"], "dimensions": {"length": 35.7, "width": 23.5, "height": 1.8}},
    "prod002": {"name": "Smartphone", "price": 799.99, "stock": 160, "category": "Electronics", "rating": 4.5, "available": True, "brand": "Umbra", "colors": ["black"], "features": {"camera": "50MP", "battery": "5Ah"}, "reviews": [{"user": "ann", "rating": 5, "comment": "good"}]},
    "prod003": {"name": "Programming Book", "price": 49.99, "stock": 75, "category": "Books", "rating": 4.2, "available": True, "author": "B. Writer", "pages": 600},
    "prod004": {"name": "Coffee", "price": 15.99, "stock": 200, "category": "Food", "rating": 4.8, "available": False, "brand": "Bean", "nutritional_info": {"calories": 2, "fat": "0g"}},
    "prod005": {"name": "Office Chair", "price": 249.99, "stock": 35, "category": "Furniture", "rating": 4.3, "available": True, "brand": "Sit", "features": ["swivel", "tilt"]},
    "prod006": {"name": "Winter Jacket", "price": 129.99, "stock": 85, "category": "Clothing", "rating": 4.6, "available": True, "brand": "North", "care": {"wash": "cold"}},
    "prod007": {"name": "Blocks", "price": 39.99, "stock": 120, "category": "Toys", "rating": 4.9, "available": True, "brand": "Brick", "pieces": 500},
    "prod008": {"name": "Blender", "price": 89.99, "stock": 62, "category": "Kitchen Appliances", "rating": 4.4, "available": True, "brand": "Whirl", "features": ["pulse"]},
    "prod009": {"name": "Yoga Mat", "price": 29.99, "stock": 95, "category": "Sports", "rating": 4.7, "available": True, "brand": "Stretch", "care": "wipe"},
    "prod010": {"name": "Face Serum", "price": 38.5, "stock": 45, "category": "Beauty", "rating": 4.8, "available": True, "brand": "Glow"},
    "prod011": {"name": "Drill Set", "price": 159.99, "stock": 30, "category": "Tools", "rating": 4.6, "available": True, "brand": "Torque"},
    "prod012": {"name": "Photo Software", "price": 129.99, "stock": 999, "category": "Software", "rating": 4.5, "available": True, "brand": "Pixel", "features": {"layers": True, "filters": 40}},
    "prod013": {"name": "Guitar", "price": 349.99, "stock": 15, "category": "Musical Instruments", "rating": 4.7, "available": True, "brand": "String"},
    "prod014": {"name": "Protein Powder", "price": 45.99, "stock": 80, "category": "Health", "rating": 4.6, "available": True, "brand": "Strong"},
}
INDEXED = ("available", "category", "name", "price", "rating", "stock")
