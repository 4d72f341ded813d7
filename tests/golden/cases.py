"""Hand-derived cases: input first, expected value last."""

NUMBERS = [("1 000", 1000.0), ("3,14", 3.14), ("1,234", 1234.0), ("1,234,567", 1234.0), (".5", 5.0), ("-7", -7.0), ("3 5", 35.0),
           ("no", None), ("", None), ("x = 12.", 12.0), ("+4,5 m", 4.5), ("1,2 и 3,4", 1.2)]

FINAL = [("a #### 42", "42"), ("#### 1,234", "1234"), ("#### 1,234,567", "1234567"[:4]), ("so 3 then 1,500", "1500"), (" none ", "none"),
         ("#### -3.5 x", "-3.5"), ("", "")]

INTEGERS = [("#### 1,234", 1), ("The answer is 7 of 9", 7), ("Ответ: 12", 12), ("ИТОГО: 5 и 6", 5), ("всего 8, 9", 8),
            ("<answer> 4 </answer> 9", 4), ("1 2 -3", -3), ("none", None), ("Получаем 15", 15)]

NORMAL = [(" 5 рублей", "5 лей"), ("10 km", "10"), ("1/2", "0.5"), ("2.500", "2.5"), ("3.", "3"), ("4/0", "4/0"), ("12 кг", "12 к"),
          ("$7", "7"), ("метр", "етр"), ("", "")]

ROOTS = [("x1 = 3, x2 = -1", [-1.0, 3.0]), ("2 и 1.5", [1.5, 2.0]), ("none", [])]

RESPONSES = [("<ANSWER> a b </ANSWER>", "a b"), ("#### 1,234", "1234"), ("#### about 5, or 6", "5"), ("1 then 2.5", "2.5"), ("none", None),
             ("<answer></answer> 5", "")]

T = "<think>{}</think><answer>{}</answer>"
FORMAT = [(T.format("a", "b"), 0.2), ("<answer>b</answer><think>a</think>", 0.1), ("<think>a</think><think>b</think><answer>c</answer>", 0.1),
          ("<think>a<answer>b", 0.0), ("", 0.0), ("<think>a</think>", 0.1)]

REASONING = [("<think>1. один два три четыре пять шесть семь восемь девять, Следовательно</think>", 0.25),
             ("<think>Шаг 1 готово</think>", 0.1), ("<think>also</think>", 0.05), ("<think>  </think>", 0.0), ("none", 0.0),
             ("<think>ВО-ПЕРВЫХ да</think>", 0.1), ("<think>abc</think>", 0.0)]

INTEGER_REWARD = [(T.format("x", "5"), "#### 5", 1.0), (T.format("x", "4"), "5", 0.4), ("the answer is 4", "5", 0.3), ("none", "5", 0.0), ("5", "", 0.0),
                  ("9223372036854775807", "-5", 0.0), ("1" * 40, "1" * 40, 1.0), ("1" * 39 + "2", "1" * 40, 0.3), ("00012", "12", 1.0), ("9" * 20, "9" * 20, 1.0)]

EXPRESSION = [("<answer>5</answer>", "5.00001", 1.0), ("<answer>abc</answer>", "ABC", 1.0), ("<answer>abc</answer>", "7", 0.0), ("5", "5", 0.0)]

CORRECTNESS = [("<answer>5</answer>", "5", 3.0), ("<answer>5</answer>", "5.2", 1.0), ("<answer>9</answer>", "5", -0.5), ("none", "5", -1.0),
               ("<answer>Yes</answer>", "yes", 3.0), ("<answer>no</answer>", "yes", -0.5), ("<answer>1</answer>", None, 0.0), ("<answer>1</answer>", "0", -0.5)]

TRUNCATION = [("a <answer>", True, -0.5), ("a </answer> b", True, -0.5), ("a", True, -1.0), ("a", False, 0.0)]
