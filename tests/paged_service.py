"""A service of three pages for the tests."""


class Catalogue:
    @staticmethod
    def schema(stream):
        return "id long, title string, updated_at string"

    @staticmethod
    def pages(stream):
        return 3 if stream == "papers" else 0

    @staticmethod
    def page(stream, number):
        return [{"id": 10 * number + i, "title": f"{stream} {number}.{i}", "updated_at": f"2024-0{number + 1}-0{i + 1}"} for i in range(4)]


CATALOGUE = Catalogue()
